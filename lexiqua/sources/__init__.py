"""Lexiqua sources."""
