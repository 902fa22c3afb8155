"""Column functions: draws, value generators, formulas, conditions, mappings, labels."""
