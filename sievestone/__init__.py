"""Block-indexed byte search and structural analytics over DataFrames."""
