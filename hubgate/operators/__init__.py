"""Operators of the retrieval analysis, as functions from DataFrames to DataFrames."""
