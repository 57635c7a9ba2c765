"""operators of causeway."""
