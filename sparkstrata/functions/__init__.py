"""Column functions: text, paths and structure."""
