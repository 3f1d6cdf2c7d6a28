"""Relational operators on corpora, sequences and results."""
