"""Market-data and research jobs on Spark DataFrames."""
