"""Column expressions for text, scores and vectors."""
