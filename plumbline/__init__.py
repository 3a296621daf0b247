"""Plumbline: health analytics over source code and text collections, on Spark."""

__version__ = "0.1.0"
