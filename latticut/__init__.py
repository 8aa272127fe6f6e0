"""Graph cut analytics on Spark DataFrames."""
