"""Functions of the splat-cloud engine."""
