"""Spark-native engine for profiling, cleaning and harmonizing loosely typed tables."""

__version__ = "0.1.0"
