"""Operators for text and training data. Nothing else in the library imports this subpackage."""
