"""Operators for large text collections: quality, packing, tokenizers, near duplicates, extraction, scoring, PII."""
