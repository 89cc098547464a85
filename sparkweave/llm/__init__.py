"""Operators for large text corpora, as used to prepare training data."""
