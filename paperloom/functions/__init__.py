"""Column expressions: text in, text or flags out."""
