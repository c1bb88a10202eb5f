"""Operators: each takes and returns molecules, clusters or reads as DataFrames."""
