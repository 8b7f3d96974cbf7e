"""Point-in-time operators as functions from DataFrames to DataFrames."""
