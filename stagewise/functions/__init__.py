"""Column builders and the registry of user functions."""
