"""Relational operators over tender tables."""
