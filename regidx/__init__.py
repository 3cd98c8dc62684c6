"""Spark-native jobs that build and query a company-registry text index."""

__version__ = "0.1.0"
