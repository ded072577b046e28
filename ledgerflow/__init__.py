"""Analytics over ordered, sharded command logs, on Spark DataFrames."""
