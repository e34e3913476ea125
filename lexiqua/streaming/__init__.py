"""Lexiqua streaming."""
