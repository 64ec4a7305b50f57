"""Indicator analytics on long tables, expressed as Spark DataFrame functions."""

__version__ = "0.1.0"
