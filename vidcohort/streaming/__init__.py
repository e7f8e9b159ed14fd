"""Incremental runs over landed files."""
