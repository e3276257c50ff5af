"""Sources of the splat-cloud engine."""
