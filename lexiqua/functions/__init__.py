"""Lexiqua functions."""
