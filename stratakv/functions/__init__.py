"""Column functions over keys and versions."""
