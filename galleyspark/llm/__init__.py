"""Operators of a training-data pipeline: scans, filters, near duplicates, mixing, token output and vector search."""
