"""Vectorised words and 64-bit hashes over Arrow string batches, shared by the operators of this subpackage.

A word is a maximal run of characters other than space and U+0009..U+000D; A-Z count as a-z.  Everything here runs
inside tasks on one Arrow batch at a time; nulls are empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)[LOWER]
BYTE_VALUE[SPACE] = 0
POSITION = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 19
#: Words that are hashed together, and how many of their bytes.
WORDS, SHORT = 1 << 16, 64
#: What each byte counts for at each of the first places of a word.
_AT_PLACE = BYTE_VALUE[None, :] * POSITION[:SHORT, None]
#: Bytes of texts that are looked at together where each byte gives several numbers.
SMALL = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each text begins (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions at which words begin and end, and the index of the first word of each text."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    end[:-1] &= ~solid[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given by their bounds.

    The first bytes of WORDS words are looked up together, then the second bytes of those that have one, and so on; what words
    have after SHORT bytes is summed word by word.
    """
    out, size = np.zeros(len(starts), np.uint64), ends - starts
    for a in range(0, len(starts), WORDS):
        at, n, who = starts[a : a + WORDS], size[a : a + WORDS], np.arange(a, min(a + WORDS, len(starts)))
        for j in range(min(int(n.max()), SHORT)):
            if j:
                more = np.flatnonzero(n > j)
                at, n, who = at.take(more), n.take(more), who.take(more)
            out[who] += _AT_PLACE[j].take(data.take(at + j))
    long = np.flatnonzero(size > SHORT)
    rest = np.cumsum(size[long] - SHORT)
    cuts = np.unique(np.searchsorted(rest, np.arange(0, rest[-1] + CHUNK, CHUNK))) if len(long) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        n = size[long[a:b]] - SHORT
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(first, n) + SHORT
        values = BYTE_VALUE[data[np.repeat(starts[long[a:b]], n) + at]] * POSITION[at & 4095]
        far = np.flatnonzero(at > 4095)
        values[far] *= mix((at[far] >> 12).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        out[long[a:b]] += np.add.reduceat(values, first)
    return mix(out ^ (size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def hash_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and the index of the first word of each text."""
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets)
    return hash_spans(data, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words of each text (of the whole text where it has fewer, but some), and their first index."""
    n = np.diff(first)
    rolled = np.zeros(len(words), np.uint64)
    if len(words) >= k:
        span = len(words) - k + 1
        for j in range(k):
            rolled[:span] = rolled[:span] * SHINGLE_BASE + words[j : j + span]
    keep = np.repeat(first[1:], n) - np.arange(len(words)) >= k
    for i in np.flatnonzero((n < k) & (n > 0)):
        h = np.uint64(n[i])
        for w in words[first[i] : first[i + 1]]:
            h = np.uint64((int(h) * int(SHINGLE_BASE) + int(w)) & (2**64 - 1))
        rolled[first[i]] = h
        keep[first[i]] = True
    out = mix(rolled[keep])
    return out, np.searchsorted(np.flatnonzero(keep), first)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the named text column has about `most` bytes each; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        size = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64), 16))
        own = np.diff(size, prepend=0)
        long = np.flatnonzero(own > most)
        cuts = np.unique(np.concatenate([[0, batch.num_rows], np.flatnonzero(np.diff(size // most)) + 1, long, long + 1])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system; without it a worker process keeps its peak for as long as Spark reuses it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(rows: Callable) -> Callable:
    """A function over a partition's batches that gives back its worker's memory at the end."""

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run
