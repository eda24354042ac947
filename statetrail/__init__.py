"""Change histories and the operations that led to them, on Spark DataFrames."""
