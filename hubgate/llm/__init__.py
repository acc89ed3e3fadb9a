"""Operators for large text corpora: filtering, deduplication, decontamination, tokenization, formatting."""
