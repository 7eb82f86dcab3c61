"""operators of the curated-data engine."""
