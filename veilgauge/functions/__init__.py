"""Column expressions: keyed randomness and table encodings."""
