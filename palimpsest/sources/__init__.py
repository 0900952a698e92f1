"""Files, stores and table readers."""
