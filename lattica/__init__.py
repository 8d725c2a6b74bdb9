"""lattica: typed table queries, interval edits, signal windows and search as Spark DataFrames."""
