"""Operators of a large-scale training-data pipeline: mixing, deduplication, scoring, sharding, packing."""
