"""Operators for large training corpora: search, deduplication, archives, packing, classifiers."""
