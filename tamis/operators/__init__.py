"""Operators: every public name takes and returns DataFrames."""
