"""Spark-first analytics and learning library."""
