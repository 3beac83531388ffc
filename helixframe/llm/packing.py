"""Vector best-fit packing of tokenised documents into sequences of a fixed length.

A sequence has three capacities: tokens, documents, and attention cost (the sum of the squares of its pieces' lengths).  Pieces
are taken from the longest to the shortest.  Each goes to the sequence, of those where it fits under every capacity, that
minimises the weighted norm of what is left of all capacities, or that maximises the weighted dot product of what is left and
what the piece takes; where it fits in none, a new sequence begins.

How it runs: pieces as long as a sequence are sequences already.  The others are dealt at random over shards of about SHARD
pieces, and a task packs the lengths of one shard (numbers only; contents stay where they are and are joined afterwards).  Every
shard leaves a few sequences that are not full, against thousands that are, so the number of shards hardly counts in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .recovery import stored
from .text import slices

#: Tokens of a sequence; pieces that are packed together in one task; the id that ends a document.
TOKENS, SHARD, END = 2048, 50_000, 0
#: Of tokens, documents and attention cost: how much what is left of them counts.
WEIGHTS = (1.0, 1.0, 1.0)
RULES = ("norm", "dot")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece.  Of equally good bins the first one is taken; a piece beyond a capacity has a bin of its own."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    lengths = np.asarray(lengths, np.int64)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    left = np.zeros((3, len(lengths)), np.int64)  # of each capacity, by bin
    bins, open_bins = 0, np.zeros(0, np.int64)
    least = max(1, int(lengths.min(initial=1)))
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for first, past in zip(cuts, np.append(cuts[1:], len(order))):  # pieces of one length take the same of every capacity
        n = int(lengths[order[first]])
        take = (n, 1, n * n)

        def value(rest):
            """The less, the better; of numbers or of arrays."""
            out = 0.0
            for w, r, t, c in zip(weights, rest, take, capacity):
                out = out + (w * ((r - t) / c) * ((r - t) / c) if rule == "norm" else -(w * (r / c) * (t / c)))
            return out

        open_bins = open_bins[(left[0, open_bins] >= least) & (left[1, open_bins] > 0)]
        rest = left[:, open_bins]
        fits = (rest[0] >= n) & (rest[2] >= n * n)
        at = np.append(open_bins[fits], np.zeros(past - first, np.int64))  # the last ones are not begun
        begun = len(at) - (past - first)
        values = np.append(value(rest[:, fits]), np.full(past - first, np.inf))
        before = bins
        for item in order[first:past].tolist():
            best = int(values[:begun].argmin()) if begun else 0
            if not begun or values[best] == np.inf:
                best = begun
                begun += 1
                at[best] = bins
                left[:, bins] = capacity
                bins += 1
            chosen = int(at[best])
            a, b, c = left[:, chosen].tolist()
            where[item], offset[item] = chosen, capacity[0] - a
            a, b, c = a - n, b - 1, c - n * n
            left[:, chosen] = a, b, c
            values[best] = value((a, b, c)) if a >= n and b > 0 and c >= n * n else np.inf
        open_bins = np.append(open_bins, np.arange(before, bins))
    return where, offset


def pieces(docs: DataFrame, vocabulary_path: str, tokens: int = TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece INT, start LONG, length LONG, ids BINARY): the ids of each text, little-endian 32-bit, with END after the last.

    More than `tokens` ids are cut into pieces of `tokens`, of which the first may be shorter; start counts the ids before a
    piece.  Null text: as empty, the END alone.  A repeated row has pieces of its own.  Narrow: no shuffle.
    """
    if tokens <= 0:
        raise ValueError("a sequence has one token at least")
    table = docs.sparkSession.sparkContext.broadcast(bpe.load(vocabulary_path))
    end = np.array([END], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(table.value)
        for batch in slices(batches, "text", 4 << 20):
            ids = [x + end for x in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            count = -(-n // tokens)
            of = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            past = n[of] - (count[of] - 1 - piece) * tokens
            start = np.maximum(past - tokens, 0)
            cut = [ids[i][a:b] for i, a, b in zip(of.tolist(), (start * 4).tolist(), (past * 4).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(past - start), pa.array(cut, pa.binary())], ["id", "piece", "start", "length", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(rows, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def pack(items: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", shard: int = SHARD) -> DataFrame:
    """items (length LONG, ...) with sequence_id LONG and offset LONG added; columns of items of these names are replaced.

    Capacities are tokens, documents (none given: as many as tokens) and attention (none given: tokens squared; neither then
    binds).  offset is the sum of the lengths before a piece in its sequence.  Sequences have any numbers, the same for the
    same rows in the same partitions.  A piece beyond a capacity has a sequence of its own; no rows, no sequences.
    """
    capacity = (tokens, documents or tokens, attention or tokens * tokens)
    if min(capacity) <= 0 or shard <= 0:
        raise ValueError("capacities are positive")
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    # files: row numbers and shards are then the same for whoever reads them again
    rows = stored(items.select(*kept, F.monotonically_increasing_id().alias("_row")))
    alone = F.col("length") >= tokens
    rest = rows.where(~alone)
    shards = max(1, -(-rest.count() // shard))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        part, row, length = (table.column(c).to_numpy() for c in ("part", "row", "length"))
        order = np.lexsort((row, part))
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            at = order[a:b]
            where, offset = best_fit(length[at], capacity, weights, rule)
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array((part[at] << 32) | where), pa.array(offset)], ["_at", "sequence_id", "offset"])

    numbers = rest.select(F.pmod(F.xxhash64("_row"), F.lit(shards)).alias("part"), F.col("_row").alias("row"), F.col("length").cast("long").alias("length"))
    placed = numbers.repartition(shards, "part").mapInArrow(packed, "_at long, sequence_id long, offset long")
    out = rows.join(placed, rows["_row"] == placed["_at"], "left")
    return out.select(*kept, F.coalesce("sequence_id", -1 - F.col("_row")).alias("sequence_id"), F.coalesce("offset", F.lit(0)).alias("offset"))
