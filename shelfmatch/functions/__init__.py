"""Column functions: text, codes and vectors."""
