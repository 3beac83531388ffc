"""Constraints on sequences: GC content and homopolymer runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

#: Default bounds of GC content, and of run length.
GC_MIN, GC_MAX, MAX_RUN = 0.45, 0.55, 3


def gc_content(seq: Column) -> Column:
    """Share of G and C, in either case, among all characters; 0 for an empty sequence."""
    return F.when(F.length(seq) == 0, 0.0).otherwise(F.length(F.regexp_replace(seq, "[^GCgc]", "")) / F.length(seq))


def longest(column: pa.Array) -> pa.Array:
    """Length of the longest run in each text of a batch."""
    column = flat.large(column)
    parts = [np.zeros(0, np.int32)]
    for first, past in flat.pieces(column):
        codes, offsets = flat.letters(column.slice(first, past - first))
        begins = np.ones(len(codes) + 1, bool)
        begins[1:-1] = codes[1:] != codes[:-1]
        begins[offsets] = True
        edges = np.flatnonzero(begins)
        some = np.flatnonzero(np.diff(offsets))
        out = np.zeros(past - first, np.int32)
        if len(some):
            out[some] = np.maximum.reduceat(np.diff(edges), np.searchsorted(edges, offsets[some]))
        parts.append(out)
    return pa.array(np.concatenate(parts))


_longest = F.arrow_udf(longest, T.IntegerType())


def longest_run(seq: Column) -> Column:
    """Length of the longest run of one character, case counting; 0 for an empty sequence."""
    return F.when(seq.isNotNull(), _longest(seq))


def has_run_over(seq: Column, most: int) -> Column:
    """Whether a character, case not counting, repeats more than `most` times in a row."""
    return F.upper(seq).rlike(rf"(?s)(.)\1{{{most}}}")


def meets(seq: Column, gc_min: float = GC_MIN, gc_max: float = GC_MAX, max_run: int = MAX_RUN) -> Column:
    """Whether GC content lies within bounds, both included, and no run is too long."""
    return gc_content(seq).between(gc_min, gc_max) & ~has_run_over(seq, max_run)
