"""Operators on features: measuring, normalising, budgets, status counters."""
