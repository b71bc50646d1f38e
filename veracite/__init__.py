"""Citation verification and text analytics on Spark DataFrames."""
