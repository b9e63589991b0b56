"""Spark-first numeric analytics, incremental learning and corpus preparation."""

__version__ = "0.1.0"
