"""Arbora: a Spark-native engine for program runs over array, text, image and run-store data."""

__version__ = "0.1.0"
