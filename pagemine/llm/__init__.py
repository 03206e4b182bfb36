"""Operators for preparing training text: quality, licences, near-duplicates, extraction, tokens, mixing, archives."""
