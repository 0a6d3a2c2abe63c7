"""Gridded, sparse and irregular space-time analytics on Spark DataFrames."""
