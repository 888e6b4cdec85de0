"""Column functions: text, vectors and maps."""
