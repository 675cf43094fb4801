"""Column-level functions: cleaning, casts, labels."""
