"""Operators as functions from DataFrames to DataFrames. Columns are named relation.attribute throughout."""
