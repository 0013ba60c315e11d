"""Relational operators over gridded data."""
