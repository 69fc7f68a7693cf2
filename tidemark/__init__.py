"""Features that are correct as known at a given time, on Spark DataFrames."""
