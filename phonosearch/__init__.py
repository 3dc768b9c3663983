"""Phonetic search and data processing on Spark tables."""
