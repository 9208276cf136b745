"""Structured Streaming jobs over the batch operators."""
