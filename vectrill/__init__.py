"""Vector search and text preparation on Spark DataFrames."""
