"""Composed plans: the engine and the driver queries."""
