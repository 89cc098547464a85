"""Graph analytics on DataFrames."""
