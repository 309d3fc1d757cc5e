"""functions of the lectern engine."""
