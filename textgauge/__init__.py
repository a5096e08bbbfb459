"""A text-complexity and corpus analytics engine on Spark DataFrames."""
