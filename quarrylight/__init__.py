"""Quarrylight: relational source-code intelligence on PySpark."""

__version__ = "0.1.0"
