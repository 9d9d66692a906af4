"""Basket analytics and label agreement as plain PySpark DataFrame functions."""

__version__ = "0.1.0"
