"""Operators of a training-data pipeline: mixing, sharding, deduplication, filtering, archives."""
