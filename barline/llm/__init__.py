"""Operators for preparing training data: deduplication, packing, scoring, search and media columns."""
