"""Readers of markdown trees, test files, JSON-lines logs and Parquet tables."""
