"""Column expressions and small reusable DataFrame idioms."""
