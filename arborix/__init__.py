"""Document-tree search and metric resolution on Spark DataFrames."""
