"""Structured Streaming forms of the operators; they share the batch expressions."""
