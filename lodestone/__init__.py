"""Property-graph analytics for code-like systems, as Spark DataFrames."""
