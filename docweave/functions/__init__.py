"""Column expressions: pure functions from Columns to Columns."""
