"""Spark-first analytics for finding, masking and verifying sensitive text."""
