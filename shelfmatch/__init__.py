"""Product matching, vector search and evaluation as Spark DataFrame plans."""
