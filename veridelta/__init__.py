"""Data-change validation and evidence analytics on Spark DataFrames."""
