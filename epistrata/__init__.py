"""Spark-first analysis of cytosine-level DNA methylation data."""
