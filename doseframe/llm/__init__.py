"""Operators of a training-data pipeline: filters, archives, near duplicates, tokens, scores, mixing, shards and search."""
