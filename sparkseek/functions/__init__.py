"""Column functions: text, regular expressions, time references, vectors."""
