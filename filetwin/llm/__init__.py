"""Operators for training-data pipelines: search, deduplication, formatting, privacy, scoring, packing."""
