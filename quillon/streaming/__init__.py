"""Structured Streaming forms of the log summaries."""
