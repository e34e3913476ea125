"""Lexiqua plans."""
