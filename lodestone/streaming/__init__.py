"""Streaming of the retrieval engine."""
