"""Operators on DataFrames. Each takes and returns DataFrames and names its key columns."""
