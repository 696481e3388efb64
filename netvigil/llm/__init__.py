"""Operators for large text corpora: scoring, cleaning, deduplication, encoding and layout."""
