"""Spark-first analytics for messy public-record data."""
