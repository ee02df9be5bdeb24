"""Operators that prepare training data: quality, deduplication, extraction, packing, safety, search, filtering, mixing."""
