"""Table flows."""
