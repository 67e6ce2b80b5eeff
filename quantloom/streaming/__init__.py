"""Structured Streaming forms of the panel operators."""
