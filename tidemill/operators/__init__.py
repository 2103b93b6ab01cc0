"""Table, check, lineage, run, version and definition operators: DataFrames in, DataFrames out."""
