"""Structured Streaming maintenance of current state."""
