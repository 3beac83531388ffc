"""Arrow columns of texts and bytes as flat numpy arrays, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on at once; a longer value is a piece of its own.
PIECE = 1 << 22


def _offsets(array: pa.Array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]


def _data(array: pa.Array) -> np.ndarray:
    offsets = _offsets(array)
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)


def large(array: pa.Array) -> pa.Array:
    """The column with 64-bit offsets, nulls as empty values."""
    text = pa.types.is_string(array.type) or pa.types.is_large_string(array.type)
    return array.cast(pa.large_string() if text else pa.large_binary()).fill_null("" if text else b"")


def pieces(array: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first, past the last) rows of pieces that hold at most `limit` bytes, or one row."""
    offsets = _offsets(array)
    first = 0
    while first < len(array):
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, past
        first = past


def values(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values in a row, where each begins and the last ends), of `large` columns."""
    offsets = _offsets(array)
    return _data(array), offsets - offsets[0]


def letters(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, where each begins and the last ends), of `large` columns."""
    data, offsets = values(array)
    if not len(data) or data.max() < 128:
        return data, offsets
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begin at all other bytes
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), before[offsets]


def texts(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The column of texts that `letters` gives back as (codes, offsets)."""
    if codes.dtype == np.uint8:
        return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(codes))])
    whole = codes.tobytes().decode("utf-32-le")
    return pa.array([whole[a:b] for a, b in zip(offsets[:-1], offsets[1:])], pa.large_string())


def column(codes: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The column, large_string of ASCII or large_binary, of values that lie one behind the other."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(codes))])


def by_pieces(array: pa.Array, work: Callable[[pa.Array], pa.Array], kind: pa.DataType, limit: int = PIECE) -> pa.Array:
    """What `work` makes of the pieces of a column, put together as `kind`; null where the column is."""
    wide = large(array)
    parts = [work(wide.slice(first, past - first)) for first, past in pieces(wide, limit)]
    out = pa.concat_arrays(parts).cast(kind) if parts else pa.array([], kind)
    return pc.if_else(array.is_valid(), out, None) if array.null_count else out


def sliced(batch: pa.RecordBatch, name: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose column `name` holds at most `limit` bytes, or that are one row.

    Parts are copies, since `if_else` keeps the offsets of a slice beside a buffer that begins anew.
    """
    for first, past in pieces(large(batch.column(name)), limit):
        yield batch if past - first == batch.num_rows else batch.take(pa.array(np.arange(first, past)))
