"""Column functions: texts, identifiers, vectors, scores."""
