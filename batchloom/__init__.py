"""Restartable batch data processing expressed as Spark DataFrames."""

__version__ = "0.1.0"
