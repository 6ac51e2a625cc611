"""Operators: every function takes DataFrames plus column names and returns a DataFrame."""
