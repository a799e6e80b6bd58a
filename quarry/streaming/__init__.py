"""Structured Streaming helpers (an extra over the batch surface)."""
