"""Table-to-table operators. Every one takes and returns DataFrames."""
