"""Operators for preparing text corpora: counting, cleaning, deduplicating, packing."""
