"""podium: contest-standings analytics on Spark DataFrames."""
