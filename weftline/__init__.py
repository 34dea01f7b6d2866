"""Documents, relations, retrieval and rules as Spark DataFrame plans."""
