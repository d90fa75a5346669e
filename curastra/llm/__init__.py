"""Operators for preparing training data: deduplication, filters, packing, tokenizing."""
