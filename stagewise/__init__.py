"""Staged extraction over tables, expressed as Spark DataFrame operations."""
