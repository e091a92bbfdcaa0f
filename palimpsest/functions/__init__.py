"""Column functions: text, colour, geometry, lexicon."""
