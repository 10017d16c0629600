"""Scalar functions as Column expressions, and the search configuration."""
