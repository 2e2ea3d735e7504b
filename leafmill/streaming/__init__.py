"""Incremental upkeep of the tables."""
