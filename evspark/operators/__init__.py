"""Operators: DataFrames in, DataFrame out; lazy, and nothing is collected."""
