"""Operators for preparing training text: fingerprints, language, search, dedup, tokens, packing."""
