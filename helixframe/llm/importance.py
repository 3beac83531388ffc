"""Importance resampling towards a target: documents whose hashed word features are likelier in the target are drawn more often.

Features are runs of 1 to `grams` words, hashed into BUCKETS; a bucket's gain is the logarithm of the ratio of its shares, each
with one added, in the target and in the documents.  A document's weight is the mean gain of its features.  Adding Gumbel noise,
a function of a seed and the document's id alone, and taking the highest scores draws without replacement by weight.

How it runs: the texts of a batch are joined with a sentinel byte between them, one pass of a regular expression finds all
words and sentinels, and the places of the sentinels, searched by position, part documents: runs across them don't count.
Bucket counts are summed by task, then by bucket: BUCKETS numbers each for documents and target, which are what tasks get back
in a second pass that weighs documents.  Ranks come from a range-partitioned sort of the rows at or above the score that is
drawn last; a histogram of the scores (whole numbers, some ten thousand values) finds it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recovery import stored
from .text import LOWER, slices, utf8

BUCKETS, GRAMS, SEED = 10_000, 1, 2024
#: Fewest words of a document that can be drawn; per cent of those that are.
LEAST_WORDS, PERCENT = 20, 10
#: Gains, weights and noise are whole thousandths.
UNIT = 1000.0
#: A byte that no UTF-8 text has.
SENTINEL = b"\xff"
_TOKENS = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")
#: Most words whose bucket a task keeps.
KEPT_WORDS = 1 << 19


class _Crc(dict):
    """The CRC-32 of every word asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = zlib.crc32(word)
        return out


def features(column: pa.Array, grams: int, known: _Crc) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n from 1 to grams: (text of each run of n words, CRC-32 of the run); the first yield has all words."""
    data, offsets = utf8(column)
    raw = LOWER[data].tobytes()
    if SENTINEL in raw:  # in texts that are not UTF-8 only; it counts as any byte from 0x80 on
        raw = raw.replace(SENTINEL, b"\xfe")
    joined = SENTINEL.join([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
    found = _TOKENS.findall(joined)
    if len(known) > KEPT_WORDS:
        known.clear()
    known[SENTINEL] = -1
    code = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
    bounds = np.flatnonzero(code < 0)  # of documents, among words and sentinels
    place = np.flatnonzero(code >= 0)
    yield np.searchsorted(bounds, place), code[place]
    spaced, last = [b" " + w for w in found] if grams > 1 else [], code
    for n in range(2, grams + 1):
        if len(found) < n:
            return
        last = np.fromiter(map(zlib.crc32, spaced[n - 1 :], np.maximum(last[: len(found) - n + 1], 0).tolist()), np.int64, len(found) - n + 1)
        begin = np.arange(len(last))
        inside = np.searchsorted(bounds, begin) == np.searchsorted(bounds, begin + n)  # no sentinel among the n
        yield np.searchsorted(bounds, begin[inside]), last[inside]


def bucket_counts(docs: DataFrame, text_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; null counts as empty.  As many numbers as buckets reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), _Crc()
        for batch in slices(batches, "text"):
            for _, crc in features(batch.column("text"), grams, known):
                total += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of a bucket's shares in target and source), with one added to every bucket of both."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(UNIT * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text_col: str = "text", grams: int = GRAMS) -> DataFrame:
    """(row STRUCT<all columns of docs>, n_words, n_features, weight LONG): the floored mean gain of a text's features, 0 without any."""
    table = docs.sparkSession.sparkContext.broadcast(gain)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Crc()
        for column in batches:
            whole = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [_weighed(b.column(0), table.value, grams, known) for b in slices(iter([whole]), "text")]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(x) if parts else np.zeros(0, np.int64)) for x in (zip(*parts) if parts else [()] * 3)], ["n_words", "n_features", "weight"])

    return packed.select("row", weighed("text").alias("w")).select("row", "w.*")


def _weighed(column: pa.Array, gain: np.ndarray, grams: int, known: _Crc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, number, total = None, np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for of, crc in features(column, grams, known):
        value = gain[crc % len(gain)]
        n = np.bincount(of, minlength=len(column))
        words = n if words is None else words
        number += n
        up = np.concatenate([[0], np.cumsum(value)])  # texts stand in order
        end = np.cumsum(n)
        total += up[end] - up[end - n]
    return words, number, total // np.maximum(number, 1)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel variate) of the first 32 bits of sha256("seed:id"); a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long")
    return F.floor(F.lit(-UNIT) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank), a row for each document; rank counts the drawn ones from 1, others have null.

    Of the N documents with least_words words or more, floor(percent N / 100) of the highest scores are drawn, of equal ones
    those of the smaller id; a null id comes first.  Null texts are empty.  Repeated rows are documents of their own, and as
    like as they are, any order of theirs is right.  Without target or documents all shares are even.
    """
    source, wanted = bucket_counts(docs, text_col, grams, buckets), bucket_counts(target, text_col, grams, buckets)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weighed = weights(picked, gains(source, wanted), "text", grams)
    scored = weighed.select(F.col("row.id").alias("id"), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("row.id"), seed)).alias("score"))
    scored = stored(scored.select("*", F.monotonically_increasing_id().alias("row")))  # read several times below; texts stay behind
    last, total = _last(scored.where(F.col("n_words") >= least_words), percent)
    above = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    out = ["id", "n_features", "weight", "score"]
    ranked = _ranked(scored.where(above), F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("row").asc())
    drawn = ranked.select(*out, F.when(F.col("rank") <= total, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~above).select(*out, F.lit(None).cast("long").alias("rank"))).withColumnRenamed("id", id_col)


def _last(eligible: DataFrame, percent: int) -> tuple[int, int]:
    """(least score of a drawn row, how many are drawn)."""
    steps = eligible.groupBy("score").agg(F.count("*").alias("n")).collect()  # scores lie within some ten thousand whole numbers
    total = percent * sum(r["n"] for r in steps) // 100
    reach = 0
    for r in sorted(steps, key=lambda r: -r["score"]):
        if reach >= total:
            break
        reach, last = reach + r["n"], r["score"]
    return (last, total) if total > 0 else (2**62, 0)


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank LONG: their places in a total order, from 1.  Partitions by range, each after the number of rows before it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}  # one a partition
    before, reach = {}, 0
    for p in sorted(sizes):
        before[p], reach = reach, reach + sizes[p]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at + 1, at + 1 + batch.num_rows))], [*batch.schema.names, "rank"])
            at += batch.num_rows

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    return placed.mapInArrow(numbered, f"{kinds}, rank long")
