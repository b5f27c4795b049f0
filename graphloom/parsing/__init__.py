"""Source text to nested facts."""
