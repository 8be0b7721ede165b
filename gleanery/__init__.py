"""gleanery: corpus analytics on Spark DataFrames."""
