"""Block parity: after every k nucleotides one that tells whether G and C occur an even number of times."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

#: The only rule, A after an even number and T after an odd one, and the default block length.
RULE, BLOCK = "GC_even_A_odd_T", 7


def _check(k: int, rule: str) -> None:
    if k <= 0:
        raise ValueError("the block length must be positive")
    if rule != RULE:
        raise NotImplementedError(f"unknown parity rule {rule!r}")


def _blocks(n: np.ndarray, width: np.ndarray | int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks of values of n characters that begin at `first`: how many each value has, their numbers, begins and ends."""
    count = -(-n // width)
    before = np.cumsum(count) - count
    place = np.arange(count.sum())
    begin = place * width if isinstance(width, int) else place * np.repeat(width, count)
    begin += np.repeat(first - before * width, count)
    return count, place - np.repeat(before, count), begin, np.append(begin[1:], first[-1:] + n[-1:])[: len(begin)]


def _signs(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The parity nucleotides of blocks that lie one behind the other."""
    if not len(begin):
        return codes[:0]
    odd = np.bitwise_xor.reduceat(((codes | 4) == ord("G")).view(np.uint8), begin)  # C and G differ by 4
    return np.where(odd, ord("T"), ord("A")).astype(codes.dtype)


def added(seq: pa.Array, k: int = BLOCK) -> pa.Array:
    """A batch of sequences with their parity nucleotides."""

    def work(part: pa.Array) -> pa.Array:
        codes, offsets = flat.letters(part)
        count, _, begin, end = _blocks(np.diff(offsets), k, offsets[:-1])
        at = end + np.arange(len(end))
        out, rest = np.empty(len(codes) + len(at), codes.dtype), np.ones(len(codes) + len(at), bool)
        rest[at] = False
        out[rest], out[at] = codes, _signs(codes, begin)
        return flat.texts(out, offsets + np.concatenate([[0], np.cumsum(count)]))

    return flat.by_pieces(seq, work, pa.string())


@lru_cache
def _adder(k: int):
    def add_signs(seq: pa.Array) -> pa.Array:
        return added(seq, k)

    return F.arrow_udf(add_signs, T.StringType())


def add(seq: Column, k: int = BLOCK, rule: str = RULE) -> Column:
    """The sequence with its parity nucleotides; the last block may be short, an empty sequence stays empty."""
    _check(k, rule)
    return _adder(k)(seq)


def strip(seq: Column, k: int = BLOCK, rule: str = RULE) -> Column:
    """(sequence, bad_blocks ARRAY<INT>): without parity nucleotides, and the 0-based blocks whose parity fails.

    A last block of one character is the parity of an empty one.
    """
    _check(k, rule)
    return strip_by(seq, F.lit(k))


def stripped(seq: pa.Array, k: pa.Array) -> pa.Array:
    """(sequence, bad_blocks) of a batch, both null where a sequence or its block length is null, or the length not positive."""
    sizes = pc.fill_null(k.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    known = pc.and_(seq.is_valid(), pa.array(sizes > 0))
    wide = flat.large(seq)
    texts, bads, counts = [pa.array([], pa.string())], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for first, past in flat.pieces(wide):
        codes, offsets = flat.letters(wide.slice(first, past - first))
        count, number, begin, end = _blocks(np.diff(offsets), np.maximum(sizes[first:past], 1) + 1, offsets[:-1])
        bad = codes[end - 1] != _signs(codes, begin)  # a parity of G or C, which would count here, is bad at any rate
        rest = np.ones(len(codes), bool)
        rest[end - 1] = False
        texts.append(flat.texts(codes[rest], offsets - np.concatenate([[0], np.cumsum(count)])).cast(pa.string()))
        bads.append(number[bad].astype(np.int32))
        counts.append(np.bincount(np.repeat(np.arange(len(count)), count)[bad], minlength=len(count)))
    where = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    bad_blocks = pa.ListArray.from_arrays(pa.array(where), pa.array(np.concatenate(bads)))
    whole = [pa.concat_arrays(texts), bad_blocks]
    if known.false_count:
        none = pa.array(np.where(known.to_numpy(zero_copy_only=False), np.arange(len(seq)), -1))
        whole = [column.take(pc.if_else(pc.less(none, 0), None, none)) for column in whole]
    return pa.StructArray.from_arrays(whole, ["sequence", "bad_blocks"])


_strip = F.arrow_udf(stripped, T.StructType().add("sequence", T.StringType()).add("bad_blocks", T.ArrayType(T.IntegerType())))


def strip_by(seq: Column, k: Column) -> Column:
    """As strip(), with a block length for each row; null for a null sequence, fields are null where it isn't positive."""
    return F.when(seq.isNotNull(), _strip(seq, F.least(k.cast("long"), F.lit(2**31 - 2))))  # no sequence is longer
