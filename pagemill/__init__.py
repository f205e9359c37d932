"""Page, box and match analytics on Spark DataFrames."""
