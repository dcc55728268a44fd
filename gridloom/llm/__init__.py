"""Operators for large-scale text corpora, and their queries."""
