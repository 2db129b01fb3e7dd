"""Whole pipelines and their state."""
