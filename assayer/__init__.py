"""Laboratory quality-control analytics on Spark DataFrames."""
