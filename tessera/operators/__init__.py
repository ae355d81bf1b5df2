"""Plans as DataFrames."""
