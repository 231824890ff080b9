"""Operators for training-data pipelines over the documents table. Nothing outside this package imports it."""
