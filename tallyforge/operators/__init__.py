"""Operators: every one takes and returns lazy DataFrames."""
