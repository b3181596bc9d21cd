"""Column expressions: identifiers, names, text and numbers."""
