"""Spark jobs for large batch sample-processing runs."""
