"""Phrase mining against a plain count of all runs of words, with every bound on what is broadcast made small."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import phrases
from tests.llm.test_operators import clashing, empty  # noqa: F401  fixtures

SCHEMA = "doc_id long, lang string, text string"


def _rows():
    rng = random.Random(17)
    words = [f"W{i}" for i in range(25)] + ["été", "日本", "a\x0bb"]
    fixed = ["New york city hall", "in other words", "et\tcetera", "one two three", "One, two three"]
    text = lambda n: "".join(rng.choice(fixed if rng.random() < 0.3 else words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "; ", "!"]) for _ in range(n))
    rows = [(i, rng.choice(["en", "de", None]), text(rng.randint(0, 60))) for i in range(60)]
    rows += [(100, "en", None), (101, "und", ""), (102, None, " \t.,"), (103, "en", "x " * 3000), (104, "fr", "only once here"), rows[0], rows[0], (None, "en", rows[1][2])]
    return rows


def _plain(rows, least, longest, top, cover):
    out, f, n = [], {}, Counter()
    for _, lang, text in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = {}
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held.get(p[i : i + m], 0), a)
        kept = []
        for p, a in often.items():
            if 100 * held.get(p, 0) >= cover * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"known": 0, "trie": 8}, {"safe": 3}, {"known": 3, "safe": 0, "trie": 4}])
@pytest.mark.parametrize("least, longest, top, cover", [(5, 4, 2000, 80), (3, 3, 12, 50), (8, 2, 5, 80)])
def test_phrases_are_the_plain_count(spark, bounds, least, longest, top, cover):
    if bounds and longest != 4:
        pytest.skip("bounds are tried once")
    rows = _rows()
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least, longest, top, cover, **bounds)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = _plain(rows, least, longest, top, cover)
    assert len(want) > 5 and sorted(map(tuple, got.collect())) == want


def test_odd_tables(clashing, empty):  # noqa: F811
    rows = [(r.doc_id, "en", r.text) for r in clashing.collect()]
    got = phrases.collocations(clashing.withColumn("lang", F.lit("en")), least=3)
    assert sorted(map(tuple, got.collect())) == _plain(rows, 3, 4, 2000, 80)
    assert phrases.collocations(empty.withColumn("lang", F.lit("en"))).count() == 0


def test_sums_beyond_64_bits(spark):
    most = 2**62
    counts = spark.createDataFrame([([1], most), ([2], most), ([3], most - 1), ([1, 2], most - 5), ([2, 3], most - 7)], "words array<bigint>, f long")
    found = spark.createDataFrame([([1, 2, 3], most - 9), ([1, 2], most - 5)], "words array<bigint>, a long")
    got = {tuple(r.words): (r.l, r.r, r.score, r.k) for r in phrases._scored(found, counts, 4).collect()}
    a, best = most - 9, []
    for k, left, right in ((1, most, most - 7), (2, most - 5, most - 1)):
        best.append((2_000_000 * a // (left + right), k, left, right))
    score, k, left, right = min(best)
    assert got[1, 2, 3] == (left, right, score, k)
    assert [tuple(r.words) for r in phrases._not_inside(phrases._scored(found, counts, 4), found, 80, 4).collect()] == [(1, 2, 3)]


def _flat(listed):
    return np.array([c for p in listed for c in p], np.int64), np.array([len(p) for p in listed], np.int64)


@pytest.mark.parametrize("symbols, n", [(3, 40), (40, 3000), (500, 4000)])
def test_double_array_counts_all_walks(symbols, n):
    rng = np.random.default_rng(symbols)
    names = rng.choice(10**9, symbols, replace=False) - 5 * 10**8
    listed = sorted({tuple(names[rng.integers(0, symbols, rng.integers(1, 5))].tolist()) for _ in range(n)})
    trie = phrases.DoubleArray(*_flat(listed))
    codes = np.where(rng.random(20000) < 0.1, 0, names[rng.integers(0, symbols, 20000)])
    want = Counter(tuple(codes[i : i + m].tolist()) for m in range(1, 5) for i in range(len(codes) - m + 1))
    seen = trie.count(codes)
    got = {listed[p]: s for p, s in zip(trie.phrase.tolist(), seen.tolist()) if p >= 0}
    assert got == {p: want[p] for p in listed}
    assert len(trie.base) < 16 * (len(listed) * 4 + symbols)


def test_an_empty_trie_and_streams_of_nothing():
    assert not phrases.DoubleArray(*_flat([])).count(np.array([1, 2], np.int64)).any()
    assert phrases._codes(phrases._blob(np.zeros(0, np.int64))).tolist() == []
    assert phrases._codes(phrases._blob(np.array([-1, 0, 2**62], np.int64))).tolist() == [-1, 0, 2**62]


def test_words_and_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", None]).fill_null("und"), pa.array(["Ab c,d\te. f", None, "ab"])], ["lang", "text"])
    words = phrases._Words(batch)
    assert words.spelled(np.arange(len(words.key))).to_pylist() == ["ab", "c", "d", "e", "f", "ab"]
    assert words.apart.tolist() == [True, False, True, False, True, True]
    assert words.key[0] != words.key[5] and len(set(words.key.tolist())) == 6
