"""Model-duel and cultural-bias analytics on Spark DataFrames."""
