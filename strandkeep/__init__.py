"""Versioned, content-addressed file collections on Spark tables."""
