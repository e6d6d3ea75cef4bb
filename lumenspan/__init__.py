"""Answer-visibility analytics as Spark DataFrames."""
