"""Cell phenotyping and training-corpus preparation on Spark DataFrames."""
