"""plans of the curated-data engine."""
