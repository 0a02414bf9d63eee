"""Model fits in NumPy: many rows in, one set of parameters out. They run inside Arrow-batched grouped functions."""
