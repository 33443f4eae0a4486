"""Data-pipeline operators as lazy functions over Spark DataFrames."""
