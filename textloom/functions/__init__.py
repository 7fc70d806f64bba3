"""Functions of the engine; every module works on DataFrames and Columns."""
