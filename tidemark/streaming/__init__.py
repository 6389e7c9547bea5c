"""Live metrics on event streams."""
