"""Governed metrics and data preparation on Spark DataFrames."""
