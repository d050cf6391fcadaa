"""Multi-asset panel analytics on Spark DataFrames."""
