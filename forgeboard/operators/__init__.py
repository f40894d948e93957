"""Queries and maintenance steps, each a function from DataFrames to DataFrames."""
