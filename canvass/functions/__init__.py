"""Column functions: text normalisers, parsers, numbers and rules."""
