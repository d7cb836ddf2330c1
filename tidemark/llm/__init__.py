"""Operators on large text corpora. Nothing outside this package imports it."""
