"""Readers, writers and the language table."""
