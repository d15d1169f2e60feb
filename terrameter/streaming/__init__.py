"""Continuous ingest of new files."""
