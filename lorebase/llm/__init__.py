"""Operators for preparing training data: tokenising, scoring, near-duplicates, mixing, extraction."""
