"""Head-to-head match analytics on Spark: every function takes DataFrames or columns and returns them."""
