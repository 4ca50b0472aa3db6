"""Column functions: text, labels, vectors, classification metrics."""
