"""Operators for preparing training text: quality, sharding, packing, duplicates, tokens, search."""
