"""copse: interval-encoded tree queries on Spark DataFrames."""
