"""Version-control operators on DataFrames."""
