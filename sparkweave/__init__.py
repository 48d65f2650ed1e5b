"""sparkweave: graph-assisted label refinement and analytics on Spark DataFrames."""
