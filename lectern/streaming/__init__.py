"""streaming of the lectern engine."""
