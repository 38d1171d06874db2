"""Spark-native analytics for moving-object time series."""

__version__ = "0.1.0"
