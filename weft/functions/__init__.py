"""Column functions over strings, paths, hashes and arrays."""
