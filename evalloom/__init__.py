"""Retrieval-evaluation jobs as Spark DataFrame operations."""
