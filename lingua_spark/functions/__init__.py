"""Column functions: text, hashing, pre-tokenization, small statistics."""
