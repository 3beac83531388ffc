"""Operators over DataFrames of payloads or sequences."""
