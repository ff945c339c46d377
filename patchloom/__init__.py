"""Patch-corpus ETL and evaluation analytics as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
