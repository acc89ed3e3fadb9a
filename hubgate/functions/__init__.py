"""Column functions: vectors, texts and urls, hashing."""
