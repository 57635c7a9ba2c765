"""streaming of causeway."""
