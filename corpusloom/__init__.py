"""Corpus indexing and fact retrieval on Spark."""
