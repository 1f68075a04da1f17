"""Relational and mining operators, each a function from DataFrames to a DataFrame."""
