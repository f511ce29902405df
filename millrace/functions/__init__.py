"""Column expressions without user functions."""
