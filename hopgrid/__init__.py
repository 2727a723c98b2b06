"""hopgrid: closeness centrality and multi-source traversal on Spark DataFrames."""
