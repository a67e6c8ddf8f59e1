"""Ordered covering projections on Spark."""
