"""Relational operators: each is a function from DataFrames to a DataFrame."""
