"""Column functions: scalars, vectors, distributions and text."""
