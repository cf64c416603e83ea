"""Operators of a training-data pipeline: deduplication, filtering, mixing, tokens, sharding, search."""
