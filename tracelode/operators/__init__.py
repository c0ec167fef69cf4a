"""DataFrame operators. Every function takes and returns DataFrames."""
