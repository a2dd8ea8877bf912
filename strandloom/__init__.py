"""Paired-link graph analytics on Spark DataFrames."""
