"""Operators for preparing training data: quality, deduplication, encoding, packing, sharding."""
