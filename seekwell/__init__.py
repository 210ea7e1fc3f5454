"""Evidence search and text analytics on Spark DataFrames."""
