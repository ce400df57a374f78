"""Table jobs: every function takes DataFrames and returns DataFrames."""
