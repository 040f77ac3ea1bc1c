"""Text and model sources and sinks."""
