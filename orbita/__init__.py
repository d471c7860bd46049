"""Exact half-space range search over vectors, as DataFrames."""
