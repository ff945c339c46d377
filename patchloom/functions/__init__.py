"""Column expressions: no Python code runs per row in this package."""
