"""Search, rewrite and report over text and source files as lazy Spark DataFrames."""

__version__ = "0.1.0"
