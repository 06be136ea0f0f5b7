"""weft: multi-model analytics on Spark DataFrames."""
