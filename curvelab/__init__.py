"""curvelab: curve analytics on Spark DataFrames."""
