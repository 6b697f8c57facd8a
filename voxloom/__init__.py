"""voxloom: tiled-array and object analytics on Spark DataFrames."""
