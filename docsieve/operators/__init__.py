"""Relational operators over extraction and evaluation tables."""
