"""Direct base-4 coding of bytes as nucleotides, two bits each, high bits first."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

#: The nucleotides of 00, 01, 10, 11, of the default code and of the older one.
ATCG, ACGT = "ATCG", "ACGT"
HEX = "0123456789abcdef"


def pairs(alphabet: str = ATCG) -> dict[str, str]:
    """Two nucleotides for each hexadecimal digit."""
    return {HEX[d]: alphabet[d >> 2] + alphabet[d & 3] for d in range(16)}


def replaced(text: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


@lru_cache
def _spelled(alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """By byte its four nucleotides, in one number; by nucleotide its two bits, 4 for other characters."""
    letters = np.frombuffer(alphabet.encode(), np.uint8)
    value = np.full(256, 4, np.uint8)
    value[letters] = range(4)
    return letters[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3].copy().view(np.uint32).ravel(), value


def coded(content: pa.Array, alphabet: str = ATCG) -> pa.Array:
    """A batch of bytes as nucleotides."""
    four = _spelled(alphabet)[0]

    def work(part: pa.Array) -> pa.Array:
        data, offsets = flat.values(part)
        return flat.column(four[data].view(np.uint8), offsets * 4, pa.large_string())

    return flat.by_pieces(content, work, pa.string())


def decoded(dna: pa.Array, alphabet: str = ATCG) -> tuple[pa.Array, pa.Array]:
    """(bytes, why not) of a batch of nucleotides; one of the two is null, both are for null."""
    wide, value = flat.large(dna), _spelled(alphabet)[1]
    contents, errors = [pa.array([], pa.large_binary())], [pa.array([], pa.string())]
    for first, past in flat.pieces(wide):
        data, offsets = flat.values(wide.slice(first, past - first))
        bits, n = value[data], np.diff(offsets)
        odd = np.zeros(len(n), bool)
        if len(bits) and bits.max() > 3:
            odd[np.searchsorted(offsets, np.flatnonzero(bits > 3), "right") - 1] = True
        short = ~odd & (n % 4 != 0)
        bad = odd | short
        if bad.any():
            bits, n = bits[np.repeat(~bad, n)], np.where(bad, 0, n)
        four = np.ascontiguousarray(bits).view("<u4")  # two bits in each byte, the first one's are the highest of the result
        whole = flat.column((four << 6 | four >> 4 | four >> 14 | four >> 24).astype(np.uint8), np.concatenate([[0], np.cumsum(n // 4)]), pa.large_binary())
        contents.append(pc.if_else(pa.array(~bad), whole, None) if bad.any() else whole)
        errors.append(pc.if_else(pa.array(odd), "invalid nucleotide", pc.if_else(pa.array(short), "length is not a multiple of 4", pa.scalar(None, pa.string()))))
    content, error = pa.concat_arrays(contents).cast(pa.binary()), pa.concat_arrays(errors)
    there = dna.is_valid()
    return (pc.if_else(there, content, None), pc.if_else(there, error, None)) if dna.null_count else (content, error)


@lru_cache
def _udfs(alphabet: str):
    def to_dna(content: pa.Array) -> pa.Array:
        return coded(content, alphabet)

    def to_bytes(dna: pa.Array) -> pa.Array:
        return decoded(dna, alphabet)[0]

    return F.arrow_udf(to_dna, T.StringType()), F.arrow_udf(to_bytes, T.BinaryType())


def encode(content: Column, alphabet: str = ATCG) -> Column:
    """BINARY to nucleotides; null stays null."""
    return _udfs(alphabet)[0](content)


def is_valid(dna: Column) -> Column:
    """Whether a sequence has nucleotides only, in a number that whole bytes have."""
    return dna.rlike(r"\A[ATCG]*\z") & (F.length(dna) % 4 == 0)


def error(dna: Column) -> Column:
    """Why a sequence can't be decoded; null where it can, and for null."""
    return F.when(~dna.rlike(r"\A[ATCG]*\z"), "invalid nucleotide").when(F.length(dna) % 4 != 0, "length is not a multiple of 4")


def decode(dna: Column, alphabet: str = ATCG) -> Column:
    """Nucleotides to BINARY; null where `error` says why."""
    return _udfs(alphabet)[1](dna)


_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[np.frombuffer(b"ATCG", np.uint8)] = np.frombuffer(b"GCTA", np.uint8)


def inverted(dna: pa.Array) -> pa.Array:
    """A batch of sequences with their bits complemented; other characters stay."""

    def work(part: pa.Array) -> pa.Array:
        data, offsets = flat.values(part)
        return flat.column(_OTHER[data], offsets, pa.large_string())

    return flat.by_pieces(dna, work, pa.string())


_inverted = F.arrow_udf(inverted, T.StringType())


def invert(dna: Column) -> Column:
    """The sequence of the complemented bits (default code)."""
    return _inverted(dna)


_NT, _BITS = np.frombuffer(b"ATCG", np.uint8), str.maketrans({"A": "00", "T": "01", "C": "10", "G": "11"})


@F.arrow_udf(T.StringType())
def _packed(bits: pa.Array) -> pa.Array:
    def work(part: pa.Array) -> pa.Array:
        data, offsets = flat.values(part)
        n = np.diff(offsets)
        odd = n % 2 == 1
        if odd.any():
            data = np.insert(data, offsets[1:][odd], ord("0"))
        pair = (data.reshape(-1, 2) == ord("1")).astype(np.uint8)
        return flat.column(_NT[pair[:, 0] << 1 | pair[:, 1]], np.concatenate([[0], np.cumsum((n + 1) // 2)]), pa.large_string())

    return flat.by_pieces(bits, work, pa.string())


@F.arrow_udf(T.StringType())
def _unpacked(dna: pa.Array) -> pa.Array:
    def work(part: pa.Array) -> pa.Array:
        data, offsets = flat.values(part)
        value = _spelled(ATCG)[1][data]
        if len(value) and value.max() > 3:
            return pa.array([t.as_py().translate(_BITS) for t in part], pa.large_string())
        return flat.column(np.stack([value >> 1, value & 1], axis=1).ravel() + np.uint8(48), offsets * 2, pa.large_string())

    return flat.by_pieces(dna, work, pa.string())


def pack_bits(bits: Column) -> Column:
    """A string of the digits 0 and 1 to nucleotides; an odd number of bits is padded with one 0."""
    return _packed(bits)


def pack_padding(bits: Column) -> Column:
    """How many bits `pack_bits` adds."""
    return (F.length(bits) % 2).cast("int")


def unpack_bits(dna: Column) -> Column:
    """Nucleotides to a string of bits; other characters stay."""
    return _unpacked(dna)


def preview(dna: Column, n: int = 200) -> Column:
    return F.substr(dna, F.lit(1), F.lit(n))
