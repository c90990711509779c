"""Operators of a training-data pipeline: identification, deduplication, scans, mixing, tokens, extraction."""
