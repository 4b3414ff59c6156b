"""Column functions: vectors, quality signals, boxes."""
