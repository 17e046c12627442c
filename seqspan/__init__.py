"""Exact similarity search over sequences, declared as Spark DataFrames."""
