"""Operators for training-data pipelines: cleaning, near-dedup, mixing, packing, sharding and record formats."""
