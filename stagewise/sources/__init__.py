"""Document sources and record sinks."""
