"""Relational operators of the search routes."""
