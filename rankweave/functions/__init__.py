"""Column expressions and small codecs."""
