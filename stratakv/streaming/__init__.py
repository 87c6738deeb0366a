"""Change streams over the same policies."""
