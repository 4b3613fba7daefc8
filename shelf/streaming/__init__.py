"""Structured Streaming forms of the index and of the feedback fold."""
