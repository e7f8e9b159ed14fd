"""Readers of landed data and stand-in views over the given tables."""
