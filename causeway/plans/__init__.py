"""plans of causeway."""
