"""A posting-analytics engine on Spark DataFrames, SQL and Structured Streaming."""
