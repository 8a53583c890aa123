"""Sparse tensor analytics on Spark DataFrames."""
