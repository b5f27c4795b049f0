"""Column functions: paths, strings, JSON."""
