"""Continuous upkeep of the index."""
