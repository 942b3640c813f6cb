"""A code-intelligence and data-processing engine on Spark DataFrames."""
