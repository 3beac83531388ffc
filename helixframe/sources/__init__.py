"""Payloads and FASTA records, read and written."""
