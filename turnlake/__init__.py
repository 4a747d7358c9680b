"""turnlake: conversation analytics on Spark DataFrames."""
