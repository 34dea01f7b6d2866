"""Scans, the token store's operations, and sinks."""
