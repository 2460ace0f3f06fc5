"""Jobs over whole tables, each one a function from DataFrames to a DataFrame."""
