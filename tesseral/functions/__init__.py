"""Column functions: cells and their predicates, the cell codec, geodesy."""
