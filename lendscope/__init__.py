"""Portfolio credit-risk analytics on Spark DataFrames."""
