"""Tokenizer learners: each is a loop of Spark jobs over a word table."""
