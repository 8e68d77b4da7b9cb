"""Structured Streaming forms of the per-channel filters."""
