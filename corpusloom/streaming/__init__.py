"""Incremental index builds on Structured Streaming."""
