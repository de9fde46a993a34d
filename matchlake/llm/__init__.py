"""Corpus operators for training data: filtering, deduplication, tokenizing, scoring.

Nothing outside this package imports it.
"""
