"""sources of the curated-data engine."""
