"""Structured Streaming forms of the window and matching operators."""
