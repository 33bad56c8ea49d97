"""Spark-first analytics over time-stamped document corpora."""
