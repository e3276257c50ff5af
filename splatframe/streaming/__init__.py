"""Streaming of the splat-cloud engine."""
