"""Profiling and comparison of text corpora as lazy Spark DataFrames."""

__version__ = "0.1.0"
