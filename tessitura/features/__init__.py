"""Per-recording features."""
