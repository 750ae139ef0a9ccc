"""Document retrieval analytics and training-data processing on Spark DataFrames."""
