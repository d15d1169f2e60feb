"""Geodesic feature measurement as an idiomatic Spark library."""
