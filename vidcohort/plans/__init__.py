"""Whole reports, registered queries and their SQL."""
