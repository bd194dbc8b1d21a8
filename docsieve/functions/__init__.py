"""Column functions: text and number normalisation, span extraction."""
