"""The scan operators: each takes DataFrames of a trace and returns a DataFrame."""
