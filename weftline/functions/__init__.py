"""Column functions: script semantics and named scalar families."""
