"""Payment-attempt analytics on Spark DataFrames."""
