"""Similarity search over large collections of fixed-length series, on Spark DataFrames."""
