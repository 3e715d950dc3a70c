"""courtlake: racket-sport tracking analytics on Spark DataFrames."""
