"""Column functions: colours, names."""
