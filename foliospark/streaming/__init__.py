"""Structured Streaming into the same tables."""
