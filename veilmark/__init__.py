"""Sensitive-data scan over tables of documents, as plain Spark columns."""
