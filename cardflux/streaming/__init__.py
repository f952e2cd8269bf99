"""Micro-batch landing and validation with Structured Streaming."""
