"""Type registry and column expressions."""
