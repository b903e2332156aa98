"""Joins, clustering, aggregates and functions over point tables."""
