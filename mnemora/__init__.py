"""Bi-temporal memory analytics on PySpark."""
