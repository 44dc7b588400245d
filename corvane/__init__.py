"""corvane: program-security analytics on Spark DataFrames."""
