"""Page extraction, extraction-quality analytics and corpus preparation on Spark DataFrames."""
