"""Column functions: rating curves, text norms, rank metrics."""
