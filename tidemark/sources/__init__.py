"""Readers and the mapping of source payloads to records."""
