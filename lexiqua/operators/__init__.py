"""Lexiqua operators."""
