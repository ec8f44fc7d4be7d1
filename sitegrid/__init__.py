"""Analytics of scored positions on long coordinate axes, as Spark DataFrames."""
