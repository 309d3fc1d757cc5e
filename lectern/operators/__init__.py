"""operators of the lectern engine."""
