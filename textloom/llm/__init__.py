"""Operators for large training-data pipelines: packing, tokenising, fingerprints, filters, near-duplicates, privacy."""
