"""Column expressions: text fields and weighted draws."""
