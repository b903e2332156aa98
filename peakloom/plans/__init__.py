"""Whole stages composed of operators, and the queries over the driver tables."""
