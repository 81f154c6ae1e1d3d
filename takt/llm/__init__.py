"""Operators for preparing training text: quality, duplicates, secrets, mixing, packing, sharding, token files."""
