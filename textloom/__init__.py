"""String analytics, record linkage and training-data operators on Spark DataFrames."""
