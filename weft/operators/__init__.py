"""Operators of the three data models, on DataFrames."""
