"""Operators for the text side of training-data pipelines.  Nothing outside this package imports it."""
