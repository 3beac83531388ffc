"""DNA data-storage analytics on Spark DataFrames."""
