"""Survey analytics on Spark DataFrames."""
