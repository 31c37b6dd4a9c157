"""Narrowing, grouping and ranking of large record collections on Spark."""
