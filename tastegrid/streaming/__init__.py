"""Structured Streaming forms of the log-based reports (ST1-ST5)."""
