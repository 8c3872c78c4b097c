"""Keyed, versioned data on Spark: an operation log folded into state and queried as DataFrames."""
