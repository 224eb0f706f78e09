"""Column expressions: paths and report text."""
