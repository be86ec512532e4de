"""Column functions over reads."""
