"""Triple-repeat error correction: every character three times, decoded by majority."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat


def tripled(column: pa.Array) -> pa.Array:
    """A batch of texts with every character three times."""

    def work(part: pa.Array) -> pa.Array:
        codes, offsets = flat.letters(part)
        return flat.texts(np.repeat(codes, 3), offsets * 3)

    return flat.by_pieces(column, work, pa.string())


_tripled = F.arrow_udf(tripled, T.StringType())


def encode(seq: Column) -> Column:
    return _tripled(seq)


def error(seq: Column) -> Column:
    return F.when(F.length(seq) % 3 != 0, "length is not a multiple of 3")


def voted(column: pa.Array) -> pa.Array:
    """(sequence, corrected, uncorrectable) of a batch, by votes over all triplets of a piece at once.

    Every text has a multiple of three characters; null counts as empty.
    """
    column = flat.large(column)
    sequences, corrected, uncorrectable = [], [], []
    for first, past in flat.pieces(column):
        codes, offsets = flat.letters(column.slice(first, past - first))
        a, b, c = codes.reshape(-1, 3).T
        ends = offsets // 3
        differ = (a != b).astype(np.int8) + (b != c) + (a != c)
        sequences.append(flat.texts(np.where(b == c, b, a), ends))
        for n, out in ((2, corrected), (3, uncorrectable)):
            out.append(np.diff(np.concatenate([[0], np.cumsum(differ == n)])[ends]).astype(np.int32))
    merged = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
    joined = pa.concat_arrays(sequences).cast(pa.string()) if sequences else pa.array([], pa.string())
    return pa.StructArray.from_arrays([joined, pa.array(merged(corrected)), pa.array(merged(uncorrectable))], ["sequence", "corrected", "uncorrectable"])


_voted = F.arrow_udf(voted, T.StructType().add("sequence", T.StringType()).add("corrected", T.IntegerType()).add("uncorrectable", T.IntegerType()))


def decode(seq: Column) -> Column:
    """(sequence, corrected, uncorrectable): of three different characters the first stays, and counts as uncorrectable.

    Null where `error` says why.
    """
    fit = F.length(seq) % 3 == 0
    return F.when(fit, _voted(F.when(fit, seq)))
