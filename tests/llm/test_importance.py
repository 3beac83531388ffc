"""Importance resampling against a plain count of words, with runs of one to three words and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import importance
from tests.llm.test_operators import ROWS, SCHEMA, clashing, docs, empty  # noqa: F401  fixtures

TARGET = [(1, "the of w1 w2 w3 w4 the of Été naïve"), (2, None), (3, "w1 w2 w3"), (4, "")]


def _features(text, grams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def _plain(rows, target, grams, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in table for f in _features(x, grams)[1]) for table in (rows, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        n, fs = _features(text, grams)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("grams, buckets, percent", [(1, 10_000, 10), (2, 50, 60), (3, 1000, 100), (1, 7, 0)])
def test_resampling_is_the_plain_count(spark, docs, grams, buckets, percent):  # noqa: F811
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = importance.resample(docs, target, percent=percent, grams=grams, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _plain(ROWS, TARGET, grams, buckets, percent, importance.LEAST_WORDS)


def test_odd_tables(spark, clashing, empty):  # noqa: F811
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    got = importance.resample(clashing, target, percent=50, least_words=1).collect()
    want = _plain(rows, TARGET, 1, importance.BUCKETS, 50, 1)
    plain = lambda rs: sorted((tuple(r[:4]) for r in rs), key=repr)  # noqa: E731  repeated rows may swap ranks
    assert plain(got) == plain(want)
    assert sorted(r.rank for r in got if r.rank) == sorted(r[4] for r in want if r[4])
    assert importance.resample(empty, target).count() == 0
    assert {r.weight for r in importance.resample(clashing, target.limit(0)).collect()} != {0}


def test_no_feature_spans_two_texts_and_any_byte_may_stand_there():
    texts = pa.array([b"ab cd", b"", b"\xffx y\xff", None], pa.binary())
    texts = pa.Array.from_buffers(pa.string(), 4, pa.array([b"ab cd", b"", b"\xffx y\xff", b""], pa.binary()).buffers())
    (of, crc), (of2, crc2) = importance.features(texts, 2, importance._Crc())
    assert of.tolist() == [0, 0, 2, 2] and crc.tolist() == [zlib.crc32(w) for w in (b"ab", b"cd", b"\xfex", b"y\xfe")]
    assert of2.tolist() == [0, 2] and crc2.tolist() == [zlib.crc32(w) for w in (b"ab cd", b"\xfex y\xfe")]


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000, numPartitions=7).select((F.col("id") % 40).alias("a"), F.col("id").alias("b"))
    got = importance._ranked(rows, F.col("a").desc(), F.col("b").asc()).collect()
    want = {(r.a, r.b): i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r.a, r.b)), 1)}
    assert {(r.a, r.b): r["rank"] for r in got} == want
