"""sources of causeway."""
