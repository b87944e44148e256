"""Column expressions: comparison and the parsing of comma-separated fields."""
