"""Spark-first analytics over code-knowledge fact tables."""
