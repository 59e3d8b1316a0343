"""Answer streams."""
