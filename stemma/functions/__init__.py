"""Column functions: text, markers, catalogue fields."""
