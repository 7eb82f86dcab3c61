"""functions of the curated-data engine."""
