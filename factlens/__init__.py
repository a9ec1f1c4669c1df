"""factlens: fact analytics on Spark DataFrames (see README.md)."""
