"""Relational operators on incidents."""
