"""Readers and writers of game logs."""
