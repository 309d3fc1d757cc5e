"""plans of the lectern engine."""
