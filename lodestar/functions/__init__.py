"""Column functions and exact statistics."""
