"""Structured Streaming runs of the stateless steps."""
