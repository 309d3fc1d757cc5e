"""sources of the lectern engine."""
