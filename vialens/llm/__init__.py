"""Operators for preparing large text corpora as training data. Nothing else in the library imports this package."""
