"""Structured Streaming extensions; the batch operators are the reference for their results."""
