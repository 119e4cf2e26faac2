"""Column functions: text rules and vector arithmetic."""
