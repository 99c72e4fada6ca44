"""Streams scored against a stored index."""
