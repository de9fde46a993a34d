"""Structured Streaming forms of ordered operators."""
