"""Station climate extremes on Spark DataFrames."""
