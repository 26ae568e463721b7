"""Semiring matrix analytics on PySpark."""
