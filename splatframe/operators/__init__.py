"""Operators of the splat-cloud engine."""
