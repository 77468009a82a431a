"""Text, vector and graph retrieval and corpus preparation on Spark DataFrames."""
