"""Structured Streaming jobs (T-S1 .. T-S6)."""
