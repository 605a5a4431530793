"""Structured Streaming forms of the event and merge operators."""
