"""Operators for training corpora: filters, deduplication, scans, tokenizers and chat views."""
