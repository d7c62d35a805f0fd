"""Structured Streaming versions of the stateless stages."""
