"""DataFrame operators: each takes and returns DataFrames and calls no action."""
