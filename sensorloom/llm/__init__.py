"""Operators for training-data corpora: documents, web pages, benchmarks and conversations."""
