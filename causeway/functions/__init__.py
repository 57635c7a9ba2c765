"""functions of causeway."""
