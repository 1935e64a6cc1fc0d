"""Column functions: every public name takes and returns Columns."""
