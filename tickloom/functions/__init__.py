"""Column functions: text, bins, bits, numbers, arrays and hashes."""
