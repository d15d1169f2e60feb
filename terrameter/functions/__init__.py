"""Numeric kernels (numpy) and column expressions."""
