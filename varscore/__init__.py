"""Variant-score analytics on Spark DataFrames."""
