"""Column functions: text, scripts, hashes."""
