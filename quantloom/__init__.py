"""Panel time-series analytics on Spark DataFrames."""
