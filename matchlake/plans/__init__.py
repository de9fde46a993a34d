"""Registered queries, by topic, each with SQL that gives the same rows."""
