"""Operators for training-data pipelines: tokens, mixing, extraction, filters and deduplication."""
