"""Structured Streaming forms of bars and alerts."""
