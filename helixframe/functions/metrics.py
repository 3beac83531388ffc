"""Coding efficiency and names of outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_per_nt(n_bytes: Column, n_nt: Column) -> Column:
    return F.when(n_nt == 0, 0.0).otherwise(n_bytes * 8.0 / n_nt)


def compression_ratio(n_bytes: Column, n_nt: Column) -> Column:
    """Payload bytes to the bytes that the nucleotides could hold; without nucleotides infinity, or 0 for no bytes; null of null."""
    there = n_bytes.isNotNull() & n_nt.isNotNull()
    return F.when(n_nt > 0, n_bytes / (n_nt * 0.25)).when(there & (n_bytes > 0), float("inf")).when(there, 0.0)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def encoded_name(path: Column) -> Column:
    return F.concat(base_name(path), F.lit(".fasta"))


def decoded_name(path: Column) -> Column:
    """The base name without its extension (a leading dot starts none), and _decoded.bin."""
    return F.concat(F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]*$", ""), F.lit("_decoded.bin"))
