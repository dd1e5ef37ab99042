"""Operators for preparing training data: cleaning, deduplication, mixing, language ID, tokens and archives."""
