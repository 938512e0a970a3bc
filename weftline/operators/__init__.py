"""The data jobs. Each takes and returns DataFrames."""
