"""Spark-first analytics for short social-media messages and their annotations."""
