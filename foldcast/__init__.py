"""Spark-native volatility, sizing and leak-free evaluation of many time-ordered series."""

__version__ = "0.1.0"
