"""Column functions: text, geometry, vectors, SQL text."""
