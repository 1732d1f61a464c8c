"""Event-oriented time-series analytics on Spark DataFrames."""
