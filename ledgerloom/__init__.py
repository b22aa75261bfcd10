"""Spark jobs over an open-data catalogue: DataFrames in, DataFrames out."""
