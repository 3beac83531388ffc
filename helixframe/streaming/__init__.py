"""Encoding of payloads as they arrive."""
