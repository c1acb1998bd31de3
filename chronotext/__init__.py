"""Time-aligned text analytics on Spark DataFrames."""
