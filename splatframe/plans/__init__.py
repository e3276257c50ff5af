"""Plans of the splat-cloud engine."""
