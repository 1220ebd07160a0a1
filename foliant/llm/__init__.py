"""Corpus operators for training-data pipelines: quality, sharding, near-duplicates, PII, token files,
media payloads, mixing, line deduplication, exact top-k and packing."""
