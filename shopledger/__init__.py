"""Retail transaction analytics as lazy PySpark DataFrame operators."""
