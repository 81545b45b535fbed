"""Spark analytics over wide impression tables with behaviour sequences."""

__version__ = "0.1.0"
