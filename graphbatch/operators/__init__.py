"""Graph operators on DataFrames."""
