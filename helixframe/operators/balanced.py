"""GC-balanced coding: a signal digit, then the base-4 sequence or its inverse."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import base4, flat, screen


def coded(content: pa.Array, gc_min: float = screen.GC_MIN, gc_max: float = screen.GC_MAX, max_run: int = screen.MAX_RUN) -> pa.Array:
    """(signal, dna, constraints_ok) of a batch of bytes; null fields for null."""
    dna = base4.coded(content)
    n = pc.fill_null(pc.binary_length(dna), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    gc = np.zeros(len(n), np.int64)
    wide = flat.large(dna)
    for first, past in flat.pieces(wide):
        data, offsets = flat.values(wide.slice(first, past - first))
        seen = np.concatenate([[0], np.cumsum((data == ord("G")) | (data == ord("C")), dtype=np.int64)])
        gc[first:past] = np.diff(seen[offsets])
    share = np.where(n == 0, 0.0, gc / np.maximum(n, 1))
    short = screen.longest(dna).to_numpy(zero_copy_only=False) <= max_run
    ok = (share >= gc_min) & (share <= gc_max) & short
    turned = np.where(n == 0, 0.0, (n - gc) / np.maximum(n, 1))  # which the inverse has, with the same runs
    met = np.where(ok, True, (turned >= gc_min) & (turned <= gc_max) & short)
    there = content.is_valid()
    signal = pc.if_else(there, pc.if_else(pa.array(ok), "0", "1"), None)
    chosen = pc.if_else(pa.array(ok), dna, base4.inverted(dna)) if not ok.all() else dna
    return pa.StructArray.from_arrays([signal, chosen, pc.if_else(there, pa.array(met), None)], ["signal", "dna", "constraints_ok"])


@lru_cache
def _coder(gc_min: float, gc_max: float, max_run: int):
    def balance(content: pa.Array) -> pa.Array:
        return coded(content, gc_min, gc_max, max_run)

    return F.arrow_udf(balance, T.StructType().add("signal", T.StringType()).add("dna", T.StringType()).add("constraints_ok", T.BooleanType()))


def encode(content: Column, gc_min: float = screen.GC_MIN, gc_max: float = screen.GC_MAX, max_run: int = screen.MAX_RUN) -> Column:
    """(signal, dna, constraints_ok): signal 0 and the plain sequence where it meets the constraints, else 1 and the inverse.

    The inverse is not checked: it turns GC content into 1 - GC and keeps runs, so constraints_ok tells whether what is
    returned meets the constraints.
    """
    return F.when(content.isNotNull(), _coder(gc_min, gc_max, max_run)(content))


def text(encoded: Column) -> Column:
    """Signal and sequence in one string, as FASTA files have them."""
    return F.concat(encoded["signal"], encoded["dna"])


def error(seq: Column) -> Column:
    """Why a signal with its sequence can't be decoded; null where it can."""
    signal, dna = F.substr(seq, F.lit(1), F.lit(1)), F.substr(seq, F.lit(2))
    return F.when(seq == "", "empty sequence").when(~signal.isin("0", "1"), "bad signal").when(dna == "", "no payload after the signal").otherwise(base4.error(dna))


def decoded(seq: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(bytes, why not) of a batch of signals with their sequences; one of the two is null, both are for null."""
    signal, dna = pc.utf8_slice_codeunits(seq, 0, 1), pc.utf8_slice_codeunits(seq, 1)
    content, wrong = base4.decoded(dna)
    wrong = pc.if_else(pc.equal(dna, ""), "no payload after the signal", wrong)
    wrong = pc.if_else(pc.is_in(signal, pa.array(["0", "1"])), wrong, "bad signal")
    wrong = pc.if_else(pc.equal(seq, ""), "empty sequence", wrong)
    wrong = pc.if_else(seq.is_valid(), wrong, None)
    one = pc.fill_null(pc.equal(signal, "1"), False).to_numpy(zero_copy_only=False)

    def work(part: pa.Array) -> pa.Array:
        data, offsets = flat.values(part)
        return flat.column(data ^ np.repeat(flip[part.offset : part.offset + len(part)], np.diff(offsets)), offsets, pa.large_binary())

    flip = np.where(one, 255, 0).astype(np.uint8)  # the inverse has the complemented bits
    plain = flat.by_pieces(content, work, pa.binary()) if one.any() else content
    return pc.if_else(wrong.is_null(), plain, None), wrong


@F.arrow_udf(T.BinaryType())
def _decoded(seq: pa.Array) -> pa.Array:
    return decoded(seq)[0]


def decode(seq: Column) -> Column:
    """Signal and sequence to BINARY; null where `error` says why."""
    return _decoded(seq)
