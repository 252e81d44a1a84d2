"""Operators for preparing training data: quality, search, archives, near duplicates, tokens, language, PII, packing."""
