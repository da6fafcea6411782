"""Column functions: cleaning, validation, gaps and scores. All are native expressions."""
