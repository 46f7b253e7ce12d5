"""Expressions, queries and table statements to DataFrames."""
