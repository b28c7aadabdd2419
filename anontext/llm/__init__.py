"""Operators for training-data pipelines: each has its own module, queries and SQL live in ``queries``."""
