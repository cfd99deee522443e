"""Functions from DataFrames to a DataFrame; none of them runs an action."""
