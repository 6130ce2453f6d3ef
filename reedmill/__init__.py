"""Preparation and study of text corpora for retrieval-augmented question answering, on PySpark DataFrames."""
