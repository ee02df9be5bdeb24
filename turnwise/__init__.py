"""turnwise: conversational-risk analytics on Spark DataFrames."""
