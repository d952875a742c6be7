"""Whole runs: steps of the catalogue put together, from pages to published tables."""
