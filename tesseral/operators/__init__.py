"""Operators on DataFrames of cells, intervals and occupied grids."""
