"""Operators for preparing training data; see the README for the list and the limits."""
