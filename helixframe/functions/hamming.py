"""Hamming(7,4) coding of bytes: each half byte becomes seven bits, of which any one may flip."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base4 import HEX


def codeword(nibble: int) -> str:
    """P1 P2 D1 P3 D2 D3 D4 with even parities P1 over D1 D2 D4, P2 over D1 D3 D4, P3 over D2 D3 D4."""
    a, b, c, d = (nibble >> i & 1 for i in (3, 2, 1, 0))
    return "".join(map(str, (a ^ b ^ d, a ^ c ^ d, a, b ^ c ^ d, b, c, d)))


def _nearest(word: int) -> tuple[str, str]:
    """Digit of the codeword at distance at most one, and 1 where it isn't the word itself."""
    for n in range(16):
        apart = (int(codeword(n), 2) ^ word).bit_count()
        if apart <= 1:
            return HEX[n], str(apart)
    raise AssertionError("the code is perfect")


#: By word, 0 to 127: the digit it decodes to, and whether a bit was corrected.
DIGITS, FLAGS = ("".join(x) for x in zip(*map(_nearest, range(128))))
#: By byte, the 14 bits of its two codewords.
_CODE = np.array([int(codeword(n >> 4) + codeword(n & 15), 2) for n in range(256)], np.uint64)


def _protected(content: bytes) -> bytes:
    """Four bytes are 56 bits, seven bytes of code."""
    data = np.frombuffer(content + b"\0" * (-len(content) % 4), np.uint8).reshape(-1, 4)  # the code of 0 is all zeros
    bits = _CODE[data[:, 0]] << 42 | _CODE[data[:, 1]] << 28 | _CODE[data[:, 2]] << 14 | _CODE[data[:, 3]]
    return bits.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()[: -(-len(content) * 14 // 8)]


def protected(content: pa.Array) -> pa.Array:
    """A batch of payloads in code, without the padding's length."""
    return pa.array([c.as_py() if c.as_py() is None else _protected(c.as_py()) for c in content], pa.binary())


_coded = F.arrow_udf(protected, T.BinaryType())


def padding(content: Column) -> Column:
    """How many zero bits end the code of a payload."""
    return ((8 - F.length(content) * 14 % 8) % 8).cast("int")


def encode(content: Column) -> Column:
    """(encoded BINARY, padding INT): code bits in order, with 0 to 7 zero bits at the end."""
    return F.when(content.isNotNull(), F.struct(_coded(content).alias("encoded"), padding(content).alias("padding")))


def error(encoded: Column, padding: Column) -> Column:
    return length_error(F.length(encoded), padding)


def length_error(n_bytes: Column, padding: Column) -> Column:
    """What keeps so many encoded bytes from being decoded, or null."""
    n = n_bytes * 8 - padding
    return F.when(~padding.between(0, 7), "padding is not within 0..7").when((n < 0) | (n % 7 != 0), "bits are not a multiple of 7")


#: By two words: the byte they decode to, and in how many a bit was corrected.
_BYTE = np.array([int(DIGITS[w >> 7] + DIGITS[w & 127], 16) for w in range(1 << 14)], np.uint8)
_FLIPPED = np.array([int(FLAGS[w >> 7]) + int(FLAGS[w & 127]) for w in range(1 << 14)], np.uint8)


def _corrected(encoded: bytes, padding: int) -> tuple[bytes, int]:
    """Payload and number of words with a flipped bit, of one value that `error` lets pass."""
    if not encoded:
        return b"", 0
    data = np.zeros(-(-len(encoded) // 7) * 7, np.uint8)
    data[: len(encoded)] = np.frombuffer(encoded, np.uint8)
    data[len(encoded) - 1] &= 0xFF << padding & 0xFF
    seven = np.zeros((len(data) // 7, 8), np.uint8)
    seven[:, 1:] = data.reshape(-1, 7)
    words = seven.view(">u8")[:, :1].astype(np.uint64) >> np.array([42, 28, 14, 0], np.uint64) & np.uint64((1 << 14) - 1)  # what is beyond the end is 0, which is a codeword
    half = (len(encoded) * 8 - padding) // 7
    return _BYTE[words].tobytes()[: -(-half // 2)], int(_FLIPPED[words].sum())


def corrected(encoded: pa.Array, padding: pa.Array) -> pa.Array:
    """(content, corrected) of a batch, both null where encoded is."""
    out = [(None, None) if e.as_py() is None else _corrected(e.as_py(), p) for e, p in zip(encoded, padding.to_pylist())]
    content, flips = zip(*out) if out else ((), ())
    return pa.StructArray.from_arrays([pa.array(content, pa.binary()), pa.array(flips, pa.int32())], ["content", "corrected"])


_decoded = F.arrow_udf(corrected, T.StructType().add("content", T.BinaryType()).add("corrected", T.IntegerType()))


def decode(encoded: Column, padding: Column) -> Column:
    """(content BINARY, corrected INT), corrected counting words with a flipped bit; null where `error` says why.

    An odd number of half bytes gets a zero half byte at the end.
    """
    fit = error(encoded, padding).isNull() & encoded.isNotNull() & padding.isNotNull()
    return F.when(fit, _decoded(F.when(fit, encoded), padding))
