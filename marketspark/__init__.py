"""marketspark: market-data jobs for many symbols at once, on Spark DataFrames."""
