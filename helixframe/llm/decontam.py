"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet through shared runs of LEAST words.  For each such pair, tiling repeatedly marks the longest
matches between words that no tile covers yet, found by running Karp-Rabin hashes over windows of a shrinking search length.
Tiles may lie in any order, so a reordered passage is covered as well as a verbatim one.  A pair is a leak where tiles cover
at least THRESHOLD of the item's words.

The seeds of the benchmark are broadcast behind a check of their number; a larger benchmark joins by a shuffle on the seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recovery import BROADCAST_IDS, only, stored
from .text import SMALL, hash_words, lean, shingles, slices

LEAST, THRESHOLD = 5, 0.6
#: Most words, and bytes, of a benchmark that is broadcast.
BROADCAST_WORDS, BROADCAST_BYTES = 2_000_000, 64 << 20

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _open(free: np.ndarray, size: int) -> np.ndarray:
    """At which windows of a size all words are free."""
    sums = np.concatenate([[0], np.cumsum(free)])
    return sums[size:] - sums[:-size] == size


class _Rolled:
    """Running Karp-Rabin hashes of all windows of a word sequence."""

    def __init__(self, words: np.ndarray):
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
        self.scale = _powers(_INVERSE, len(words))

    def windows(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.scale[: len(self.sums) - size]


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length) between two sequences of word hashes, each at least `least` long.

    Longest first; of equal lengths the one that starts first in the item, then in the text.
    """
    if min(len(item), len(text)) < least:
        return []
    a, b = _Rolled(item), _Rolled(text)
    free_a, free_b = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []

    def mark(size: int) -> None:
        """Mark what matches of a size there are; windows that a mark touches stay closed, so each class of equal ones is passed once."""
        ok_a, ok_b = (np.flatnonzero(_open(f, size)) for f in (free_a, free_b))
        if not len(ok_a) or not len(ok_b):
            return
        ha, hb = a.windows(size)[ok_a], b.windows(size)[ok_b]
        met = np.isin(hb, ha)
        ok_b, hb = ok_b[met], hb[met]
        order = np.argsort(hb, kind="stable")
        ok_b, hb = ok_b[order], hb[order]
        lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
        some = lo < hi
        after: dict[int, int] = {}
        for x, first, past in zip(ok_a[some].tolist(), lo[some].tolist(), hi[some].tolist()):
            if not free_a[x : x + size].all():
                continue
            at = after.get(first, first)
            while at < past and not free_b[ok_b[at] : ok_b[at] + size].all():
                at += 1
            if at < past:
                y = int(ok_b[at])
                free_a[x : x + size] = free_b[y : y + size] = False
                out.append((x, y, size))
            after[first] = at

    size = min(len(item), len(text))
    while size >= least:
        mark(size)  # windows of this size are the longest free matches left, as longer ones have been marked
        size = _next(free_a, free_b, a, b, size - 1, least)
    return out


def _next(free_a, free_b, a, b, most: int, least: int) -> int:
    """The length of the longest match between free words, at most `most`; below `least` if there is none.

    Having a match of a length implies having matches of all shorter ones, so the search length halves its way there.
    """

    def has(size: int) -> bool:
        ok_a, ok_b = (_open(f, size) for f in (free_a, free_b))
        return bool(np.isin(a.windows(size)[ok_a], b.windows(size)[ok_b]).any())

    if most < least or not has(least):
        return least - 1
    lo, hi = least, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if has(mid) else (lo, mid - 1)
    return lo


def _tiled(item: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int, int]:
    found = tiles(item, text, least)
    return len(item), sum(n for _, _, n in found), len(found)


_PAIRS = "doc_id long, item_id long, item_words long, covered long, n_tiles long"
_NAMES = [x.split()[0] for x in _PAIRS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(_NAMES))], _NAMES)


def _small(docs: DataFrame, items: list, least: int) -> DataFrame:
    """Pairs that share a seed, tiled in the same pass over the documents."""
    words, first = hash_words(pa.array([r["text"] or "" for r in items], pa.large_string()))
    seeds, bounds = shingles(words, first, least)
    owner = np.repeat(np.arange(len(items)), np.diff(bounds))
    order = np.argsort(seeds, kind="stable")
    table = docs.sparkSession.sparkContext.broadcast((seeds[order], owner[order], words, first, [r["item_id"] for r in items]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, owners, item_words, item_first, ids = table.value
        distinct = np.unique(known)
        for batch in slices(batches, "text", SMALL):
            h, start = hash_words(batch.column("text"))
            s, at = shingles(h, start, least)
            near = np.minimum(np.searchsorted(distinct, s), max(len(distinct) - 1, 0))
            hit = np.flatnonzero(distinct[near] == s) if len(distinct) and len(s) else np.zeros(0, int)
            lo, hi = np.searchsorted(known, s[hit], "left"), np.searchsorted(known, s[hit], "right")
            doc = np.searchsorted(at, hit, "right") - 1
            pairs = np.unique(np.column_stack([np.repeat(doc, hi - lo), owners[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]]), axis=0) if len(hit) else np.zeros((0, 2), int)
            doc_ids = batch.column("doc_id").to_pylist()
            yield _batch([(doc_ids[d], ids[i], *_tiled(item_words[item_first[i] : item_first[i + 1]], h[start[d] : start[d + 1]], least)) for d, i in pairs.tolist()])

    return docs.mapInArrow(lean(rows), _PAIRS)


def _large(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """The same pairs by a join on seeds, then tiled with both texts at hand."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL):
            s, at = shingles(*hash_words(batch.column("text")), least)
            of = np.repeat(np.arange(batch.num_rows), np.diff(at))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), pa.array(s.view(np.int64))], ["id", "seed"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL):
            t, ta = hash_words(batch.column("text"))
            w, wa = hash_words(batch.column("item_text"))
            d, i = (batch.column(c).to_pylist() for c in ("doc_id", "item_id"))
            yield _batch([(d[k], i[k], *_tiled(w[wa[k] : wa[k + 1]], t[ta[k] : ta[k + 1]], least)) for k in range(len(d))])

    docs = docs.withColumn("dk", row_key("doc_id", "text"))
    items = items.select(row_key("item_id", "text").alias("ik"), "item_id", F.col("text").alias("item_text"))
    of_items = items.select(F.col("ik").alias("id"), F.col("item_text").alias("text")).mapInArrow(lean(seeds), "id long, seed long").distinct().withColumnRenamed("id", "ik")
    of_docs = docs.select(F.col("dk").alias("id"), "text").mapInArrow(lean(seeds), "id long, seed long").withColumnRenamed("id", "dk")
    pairs = stored(of_docs.join(of_items, "seed").select("dk", "ik").distinct())
    there = only(docs, stored(pairs.select("dk").distinct()), "dk", "dk")
    return pairs.join(there, "dk").join(items, "ik").select("doc_id", "text", "item_id", "item_text").mapInArrow(lean(tile), _PAIRS)


def row_key(number: str, text: str) -> Column:
    """A hash that tells rows of different ids (null is one) or texts apart."""
    return F.xxhash64(F.col(number), F.col(number).isNull(), F.col(text))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Pairs (doc_id, item_id, item_words, covered, n_tiles, coverage) of documents and the benchmark items they contain.

    Words are compared with A-Z as a-z.  Null ids stay null, and their rows take part.  Items of fewer than `least` words, null and empty texts are in no pair.  Repeated
    rows of a document give repeated rows here; repeated items are items of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    words, size = items.agg(F.coalesce(F.sum(F.size(F.split("text", "[ \\t-\\r]+"))), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    small = words <= broadcast_words and size <= BROADCAST_BYTES  # as much comes to the driver
    pairs = _small(docs, sorted(items.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"])), least) if small else _large(docs, items, least)
    return pairs.withColumn("coverage", F.col("covered") / F.greatest(F.col("item_words"), F.lit(1))).where(F.col("coverage") >= threshold)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, all their columns, that contain no benchmark item.

    Of rows with one doc_id, or none, those go whose own text contains one.
    """
    keyed = docs.select(row_key("doc_id", "text").alias("doc_id"), "text")
    bad = stored(leaks(keyed, benchmark, threshold).select(F.col("doc_id").alias("_bad")).distinct())
    side = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    return docs.join(side, row_key("doc_id", "text") == side["_bad"], "left_anti")
