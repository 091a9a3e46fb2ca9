"""Column expressions: hashing, tokens, score arithmetic."""
