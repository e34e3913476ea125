"""Lexiqua: a PySpark-native engine for text-centric knowledge data."""
