"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (A-Z as a-z) with their counts as weights w.  For each term and sample, r and c follow
Gamma(2, 1) and b is uniform; with t = floor(ln w / r + b) and y = exp(r (t - b)), the sample is the (term, t) of least
a = c / (y e^r).  Two texts draw the same sample with a probability that equals their generalised Jaccard similarity, the sum
of smaller weights over the sum of larger ones.

The variates are a fixed function of (term, sample): a term's 64-bit hash picks a row of a table of ROWS x SAMPLES variates,
while the sample itself names the full hash.  Equal texts so have equal fingerprints on any machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import hash_words, mix, slices

SAMPLES, ROWS = 64, 1 << 15
#: Letters of the fingerprint for each sample: 16 bits of it.
LETTERS = 4
EMPTY = "-" * (SAMPLES * LETTERS)


class Sampler:
    """The variates and what depends on them alone; about 25 MB, built once in a task."""

    def __init__(self) -> None:
        rng = np.random.default_rng(2010)
        self.r = rng.gamma(2, 1, (ROWS, SAMPLES)).astype(np.float32)
        self.b = rng.random((ROWS, SAMPLES), dtype=np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (ROWS, SAMPLES))).astype(np.float32)
        self.once = self.log_c - self.r * (1 - self.b)  # ln a at w = 1, where t = 0

    def text(self, words: np.ndarray) -> str:
        """The fingerprint of a text, given the hashes of its words."""
        if not len(words):
            return EMPTY
        terms, counts = np.unique(words, return_counts=True)
        rows = (terms >> np.uint64(40)).astype(np.int64) & (ROWS - 1)
        log_a = self.once[rows]
        step = np.zeros(len(terms), np.int64)
        more = np.flatnonzero(counts > 1)
        if len(more):
            at = rows[more]
            r, b = self.r[at], self.b[at]
            t = np.floor(np.log(counts[more]).astype(np.float32)[:, None] / r + b)
            log_a[more] = self.log_c[at] - r * (t - b + 1)
            step[more] = 1 + np.arange(len(more))
        best = log_a.argmin(0)
        level = np.zeros(SAMPLES, np.uint64)
        again = step[best]
        if len(more):
            level = np.where(again > 0, t[again - 1, np.arange(SAMPLES)], 0).astype(np.int64).astype(np.uint64)
        drawn = mix(terms[best] + level * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        return drawn.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of samples on which two fingerprints agree: an estimate of generalised Jaccard similarity, 0 to 1."""
    x, y = (np.frombuffer(s.encode(), f"S{LETTERS}") for s in (a, b))
    return float(np.mean(x == y))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fingerprint); null and blank texts have the fingerprint EMPTY.  Narrow, no shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in slices(batches, "text"):
            words, first = hash_words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sampler.text(words[a:b]) for a, b in zip(first[:-1], first[1:])])], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, fingerprint string")


def with_successors(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (doc_id, text) as (doc_id, text, range, guest), ready for one pass in ascending order of (doc_id, text).

    Rows of a range of ids are together and in order.  After its own rows, each range has as a guest the first row of the
    next range that has rows (after the last: of the first), so a row's successor is always at hand.  One shuffle.
    """
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    levels = [i / ranges for i in range(1, ranges)]
    cuts = np.unique(np.array(docs.approxQuantile("key", levels, 0.2 / ranges) if levels else [], float)).astype(np.int64)

    @F.arrow_udf(IntegerType())
    def range_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, key.to_numpy(zero_copy_only=False), "left").astype(np.int32))

    split = docs.withColumn("range", range_of("key"))
    first = sorted((r["range"], r["k"]) for r in split.groupBy("range").agg(F.min("key").alias("k")).collect())  # a row for each range
    keys = np.array([k for _, k in first], np.int64)
    hosts = np.array([first[i - 1][0] for i in range(len(first))], np.int32)

    @F.arrow_udf(IntegerType())
    def host_of(key: pa.Array) -> pa.Array:
        x = key.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
        return pa.array(hosts[at], mask=keys[at] != x) if len(keys) else pa.nulls(len(x), pa.int32())

    places = F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(host_of("key").alias("range"), F.lit(True).alias("guest")))
    both = split.select("doc_id", "key", "text", F.explode(places).alias("at")).where("at.range is not null")
    return both.select("doc_id", "key", "text", "at.range", "at.guest").repartition(ranges, "range").sortWithinPartitions("range", "guest", "key", "text")


def edited_pairs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of texts, of their edited texts and of the texts that follow: the columns of the op3 query.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the text that follows by
    doc_id (after the last: the first).  Rows of equal doc_id follow each other by text; a null text is empty, and null ids
    come first.  A single row follows itself.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(), None
        for batch in slices(batches, "text", 2 << 20):
            ids, texts, places, guests = (batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest"))
            words, first = hash_words(batch.column("text"))
            prints = [sampler.text(words[a:b]) for a, b in zip(first[:-1], first[1:])]
            ready, edits, pairs = [], [], []
            for row in zip(ids, texts, places, guests, prints):
                if held is not None and held[2] == row[2]:
                    n = len(held[1])
                    edits.append(held[1][: n - n // 2] + row[1][: n // 2])
                    ready.append((held[0], n, hashlib.sha256(edits[-1].encode()).hexdigest(), held[4]))
                    pairs.append(row[4])
                held = None if row[3] else row
            if ready:
                words, first = hash_words(pa.array(edits, pa.large_string()))
                other = [sampler.text(words[a:b]) for a, b in zip(first[:-1], first[1:])]
                out = [(*a, e, likeness(a[3], e), likeness(a[3], p)) for a, e, p in zip(ready, other, pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    return with_successors(docs, ranges).mapInArrow(rows, schema)
