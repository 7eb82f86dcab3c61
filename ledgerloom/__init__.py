"""Curated-data analytics on Spark."""
