"""Network-detection analytics on Spark DataFrames and Structured Streaming."""
