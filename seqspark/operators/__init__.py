"""Order-dependent operators; each takes DataFrames or Sequences and returns a lazy DataFrame."""
