"""Clustering analytics on Spark: every stage is a function from DataFrame to DataFrame."""

SEED = 42
