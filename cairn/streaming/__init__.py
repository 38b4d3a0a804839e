"""Change sets as streams."""
