"""Feature-space analytics over Spark DataFrames."""
