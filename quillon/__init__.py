"""Dataset auditing and model-evaluation analytics on Spark DataFrames."""
