"""Operators for training-data corpora: fingerprints, filters, deduplication, decontamination, tokens."""
