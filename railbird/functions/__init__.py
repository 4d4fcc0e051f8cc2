"""Column expressions and ordered-data building blocks."""
