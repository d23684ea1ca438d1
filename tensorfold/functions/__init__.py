"""Value types and column expressions."""
