"""Retrieval and ranking analytics on Spark DataFrames."""
