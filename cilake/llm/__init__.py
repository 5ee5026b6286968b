"""Operators of a training-data pipeline: search, sharding, scans, filters, mixing, near copies, tokens."""
