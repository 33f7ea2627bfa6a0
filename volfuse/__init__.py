"""Volatility analytics on price and text data, expressed as Spark DataFrames."""

__version__ = "0.1.0"
