"""Column functions: text and identifiers, sequences, structures, vectors."""
