"""Operators against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import bpe, components, decontam, fingerprint, katz, line_dedup, minhash, pii, quality, recovery, suffix_dedup, warc
from helixframe.llm.queries import vocabulary_path
from helixframe.llm.text import hash_words, shingles, slices

WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "Été", "naïve", "日本"] * 20
CLASHES = ("id", "key", "n", "part", "score", "predicted", "u", "v", "train", "doc", "digest", "bands", "range", "guest", "label", "_id", "_gone", "spans", "n_chars", "start", "fold", "held_out")
SCHEMA = "doc_id long, text string"


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Texts with exact and near copies, shared passages, repeated lines, and hostile rows."""
    rng = random.Random(11)
    texts = [_prose(rng, rng.randint(1, 150)) for _ in range(40)]
    base = _prose(rng, 130).split(" ")
    for i in range(25):  # near copies, more and less alike
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    passage = _prose(rng, 60)
    texts += [f"{_prose(rng, 50)}\n{passage}\n{_prose(rng, 40)}" for _ in range(15)]
    texts += [texts[0]] * 4 + ["", "   \n\t ", None, "one", "one two three", "one two three", "x" * 3000, "ab" * 700, "\0" * 300, "é\U0001f642 " * 50, _prose(rng, 4000)]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(spark):
    df = spark.createDataFrame(ROWS[-30:] + [(None, None), (None, "a b c d e f g"), ROWS[-1], ROWS[-1], (ROWS[-2][0], "another text of the same id")], SCHEMA)
    return df.select("*", *[F.lit(None if i % 2 else "x").alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# words and hashes


def test_words_are_those_of_bytes_split():
    texts = [t or "" for _, t in ROWS]
    hashes, first = hash_words(pa.array(texts))
    seen = {}
    for t, a, b in zip(texts, first[:-1], first[1:]):
        words = t.encode().lower().split()
        assert len(words) == b - a
        for w, h in zip(words, hashes[a:b].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_of_short_texts():
    hashes, first = shingles(*hash_words(pa.array(["a b c", "", "a b c d e", "a b c d e f", "A  B\tC", None])), 5)
    assert np.diff(first).tolist() == [1, 0, 1, 2, 1, 0]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[2]


# 1: suffix dedup


def _suffix_brute(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                covered[s : s + 100] = b"\1" * 100
            else:
                seen.add(b[s : s + 100])
        spans = sum(1 for i in range(len(b)) if covered[i] and not (i and covered[i - 1]))
        out[d] = (len(b), sum(covered), spans, bytes(x for x, c in zip(b, covered) if not c))
    return out


def test_suffix_dedup(docs, empty, clashing):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == _suffix_brute(ROWS)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(clashing).count() == clashing.count()


def test_suffix_merge_of_many_runs():
    rng = np.random.default_rng(5)
    matrix = rng.integers(97, 99, (3000, suffix_dedup.WIDTH), dtype=np.uint8)
    matrix[:, 30:] = 97
    run, fine = np.sort(rng.integers(0, 200, 3000)), rng.integers(0, suffix_dedup.FINE, 3000)
    order = np.lexsort((matrix.view(f"S{suffix_dedup.WIDTH}").ravel(), fine, run))
    matrix, fine = matrix[order], fine[order]
    lcp = np.zeros(3000, np.int64)
    lcp[1:] = np.where((run[1:] == run[:-1]) & (fine[1:] == fine[:-1]), suffix_dedup._common(matrix[1:], matrix[:-1]), 0)
    out, shared = suffix_dedup.merge(suffix_dedup.Suffixes(matrix), lcp, fine, run)
    rows = [(int(fine[i]), matrix[i].tobytes()) for i in out]
    assert sorted(out.tolist()) == list(range(3000)) and rows == sorted(rows)
    for a, b, n, bucket in zip(rows, rows[1:], shared[1:], range(2999)):
        if a[0] == b[0]:
            assert n == next((k for k in range(suffix_dedup.WIDTH) if a[1][k] != b[1][k]), suffix_dedup.WIDTH)


def test_anchors_cover_every_window():
    data = np.frombuffer((("abc" * 80) + "".join(random.Random(1).choice("xyz ") for _ in range(900))).encode(), np.uint8)
    p, a, b, _ = suffix_dedup.anchors(data, np.array([0, 300, 330, len(data)]))
    windows = sorted(s for x, y in zip(a, b) for s in range(x, y + 1))
    assert windows == [s for lo, hi in ((0, 300), (300, 330), (330, len(data))) for s in range(lo, hi - 99)]
    assert ((p >= b) & (p <= a + suffix_dedup.REACH)).all()


# 2: decontamination


def _tiles_brute(item, text, least):
    out, free_a, free_b = [], [True] * len(item), [True] * len(text)
    while True:
        best, found = least, []
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and free_a[i + k] and free_b[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = [False] * best
                free_b[j : j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_are_greedy():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, text = (rng.integers(1, 5, rng.integers(0, 25)).astype(np.uint64) for _ in "ab")
        assert decontam.tiles(item, text, 3) == _tiles_brute(item.tolist(), text.tolist(), 3)


def test_tiles_of_repetitive_texts_keep_no_pairs():
    rng = np.random.default_rng(5)
    item = np.full(300, 7, np.uint64)
    text = np.where(rng.random(60_000) < 0.8, 7, rng.integers(8, 10**6, 60_000)).astype(np.uint64)
    tracemalloc.start()
    found = decontam.tiles(item, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, _, n in found) > 250 and peak < 20_000_000
    for _ in range(20):
        item, text = (np.where(rng.random(n) < 0.7, 1, rng.integers(2, 4, n)).astype(np.uint64) for n in (20, 60))
        assert decontam.tiles(item, text) == _tiles_brute(item.tolist(), text.tolist(), 5)


def test_leaks(spark, clashing, empty):
    rng = random.Random(4)
    items = [(1, _prose(rng, 40)), (2, _prose(rng, 30)), (3, ""), (4, None), (5, "too short"), (None, _prose(rng, 20))]
    a = items[0][1].split(" ")
    rows = [(1, _prose(rng, 30) + " " + items[0][1].replace('w', 'W')), (2, " ".join(a[20:] + ["x"] + a[:20])), (3, _prose(rng, 90)), (4, None), (5, ""), (6, " ".join(a[:12])), (7, items[1][1]), (7, items[1][1]), (None, items[1][1])]
    df, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.BROADCAST_WORDS, 0):
        got = sorted((r.doc_id or 0, r.item_id, r.n_tiles, r.coverage) for r in decontam.leaks(df.where("doc_id is not null"), bench.where("item_id is not null"), broadcast_words=most).dropDuplicates().collect())
        assert got == [(1, 1, 1, 1.0), (2, 1, 2, 1.0), (7, 2, 1, 1.0)]
    both = df.union(spark.createDataFrame([(None, items[5][1] + " and " + items[0][1]), (None, "clean")], SCHEMA))
    ways = [sorted(map(str, decontam.leaks(both, bench, broadcast_words=most).collect())) for most in (decontam.BROADCAST_WORDS, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 7  # null and repeated ids, either way
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean(both, bench).collect()) == sorted((d or 0, t or "") for d, t in [*rows[2:6], (None, "clean")])
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0
    assert decontam.leaks(df, bench).where("doc_id is null").count() == 1
    assert sorted(r.doc_id for r in decontam.clean(df.where("doc_id is not null"), bench).collect()) == [3, 4, 5, 6]
    assert decontam.clean(clashing, bench).columns == clashing.columns


# 3: fingerprints


def test_fingerprints_estimate_generalised_jaccard(docs, empty, clashing):
    rows = sorted(ROWS)
    got = {r.doc_id: r for r in fingerprint.edited_pairs(docs, 4).collect()}
    assert len(got) == len(rows)

    def like(a, b):
        x, y = Counter(a.encode().lower().split()), Counter(b.encode().lower().split())
        return sum((x & y).values()) / max(1, sum((x | y).values()))

    errors = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if t.split() and after.split():
            errors += [got[d].near_edited - like(t, edited), got[d].near_next - like(t, after)]
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).mean() < 0.06
    prints = {d: got[d].fingerprint for d in got}
    texts = dict(ROWS)
    for a in texts:
        for b in texts:
            if texts[a] == texts[b]:
                assert prints[a] == prints[b]
    assert fingerprint.edited_pairs(empty).count() == 0
    assert fingerprint.edited_pairs(clashing, 3).count() == clashing.count()
    assert fingerprint.fingerprints(docs).where(F.col("doc_id") == 1).first().fingerprint == prints[1]


def test_single_row_follows_itself(spark):
    r = fingerprint.edited_pairs(spark.createDataFrame([(None, "abcd ef")], SCHEMA)).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest()


# 4: revisits


def test_revisits(spark):
    h = {"ETag": "e", "content-length": "5", "Date": "d0"}
    rows = [
        ("r1", "http://www.Example.com:80/a/?b=2&a=1#x", 10, 200, "e1", "m1", h, "p1"), ("r2", "https://example.com/a?a=1&b=2", 20, 200, "e2", None, h, "p2"), ("r3", "http://example.com/a?a=1&b=2", 20, 200, "e3", None, None, "p3"),
        ("v1", "http://example.com/a?a=1&b=2&utm_source=q", 15, 304, "e1", None, {"date": "d1", "Set-Cookie": "no"}, None), ("v2", "http://example.com/a?b=2&a=1", 20, 304, None, "m1", None, None),
        ("v3", "http://example.com/a?b=2&a=1", 30, 304, "e3", None, None, None), ("v4", "http://example.com/a?b=2&a=1", 31, 304, "other", None, None, None), ("v5", "http://example.com/a?b=2&a=1", 5, 304, "e1", None, None, None),
        ("v6", None, 50, 304, "e1", None, None, None), ("v7", "http://example.com/a?b=2&a=1", None, 304, "e1", None, None, None), ("x", "http://example.com/a", 60, 404, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id string, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, payload string")
    for slices in (1, 3, 50):
        got = {r.record_id: r for r in warc.resolve(df, slices).collect()}
        assert {k: (r.target_id, r.outcome) for k, r in got.items()} == {
            "v1": ("r1", "resolved"), "v2": ("r1", "resolved"), "v3": ("r3", "resolved"), "v4": ("r3", "changed"), "v5": (None, "orphan"), "v6": (None, "orphan"), "v7": (None, "orphan"),
        }
        assert got["v1"].headers == {"ETag": "e", "content-length": "5", "date": "d1"} and got["v1"].payload == "p1"
        assert got["v4"].headers is None and got["v3"].headers == {}
    assert warc.resolve(df.limit(0)).count() == 0


def test_captures_carry_the_pages_content(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>one</p>"), (2, "http://b.org/", None)], "page_id long, url string, html string")
    got = {r.record_id: r.payload for r in warc.captures_of(pages).collect()}
    assert got == {"r1": "<p>one</p>", "r2": "", "v1": None, "v2": None}


# 5: lines


def _form(line):
    return re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", line).lower().strip()


def _distance(a, b, most):
    """Edit distance, or more than most."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        if min(row) > most:
            return most + 1
    return row[-1]


def _lines_kept(rows):
    """Texts without later lines of each group, groups by edit similarity of all pairs of forms."""
    forms = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for line in (t or "").split("\n"):
            forms.setdefault(_form(line), len(forms))
    names, group = list(forms), list(range(len(forms)))
    for i, x in enumerate(names):
        for j, y in enumerate(names[:i]):
            most = int(max(len(x), len(y)) * 0.1 + 1e-9)
            if group[i] != group[j] and abs(len(x) - len(y)) <= most and _distance(x, y, most) <= most:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        kept = []
        for line in (t or "").split("\n"):
            g = group[forms[_form(line)]]
            if not _form(line) or g not in seen:
                kept.append(line)
            seen.add(g)
        out[d] = None if t is None else "\n".join(kept)
    return out


def test_lines(spark, clashing, empty):
    rng = random.Random(8)
    words = [a + b for a in "abcdefghij" for b in ("lor", "mit", "sed", "qua")]
    long = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    rows = [(i, "\n".join(rng.sample(long, 3) + ["ok", ""])) for i in range(20)]
    rows += [(30, long[0].upper() + "!!\nok"), (31, None), (32, ""), (33, long[1] + "\n" + long[1]), (34, "12 " + long[2] + " 7"), (35, rng.choice(["x y z"]) + " of a short line")]
    changed = long[3][:-1] + ("z" if long[3][-1] != "z" else "y")
    rows.append((36, changed))
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA + ", n_chars long")

    want = _lines_kept(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {d: r.text for d, r in got.items()} == want and got[36].text == "" and got[34].text == ""
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got.values())
    out = line_dedup.dedup_lines(clashing)
    assert out.columns == [*clashing.columns, "_n_lines", "_n_removed"] and out.count() == clashing.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_near_lines_meet_and_are_verified(spark):
    rng = random.Random(2)
    base = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('aeiou')}{rng.choice('rstv')}" for _ in range(300)]
    near = list(base)
    near[-1] = "zzzz"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(reversed(base)))]
    words = [hash_words(pa.array([t]))[0] for _, t in rows]
    sims = [line_dedup.simhash(w, np.array([0, len(w)]))[0] for w in words]
    assert sims[0] == sims[2]  # the same words: edit similarity refuses
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1]}


def test_lines_of_null_ids_numbers_and_large_buckets(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(500)]
    long = " ".join(words[:40])
    rows = [(None, long), (1, long.replace(words[7], "other")), (2, "row 1 of 9 total"), (3, "row 2 of 9 total"), (4, "row 3 of 7 total")]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()} == _lines_kept(rows)
    families = [[rng.choice(words) for _ in range(24)] for _ in range(6)]
    rows = []
    for i in range(150):  # a family shares most words in another order, so that buckets have many members of several groups
        line = list(families[i % 6])
        line[rng.randrange(24)] = rng.choice(words)
        if i % 5 == 0:
            rng.shuffle(line)
        rows.append((i, " ".join(line)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _lines_kept(rows)


def test_long_texts_come_in_pieces(spark):
    rng = random.Random(4)
    long = "\n".join(_prose(rng, 30) for _ in range(60))
    rows = [(1, long), (2, "a short one"), (3, long.split("\n")[41] + "\nA short one"), (4, long)]
    piece, line_dedup.PIECE = line_dedup.PIECE, 2000
    try:
        numbers = [r.line_no for r in line_dedup.lines_of(spark.createDataFrame(rows, SCHEMA).coalesce(1).selectExpr("doc_id as doc", "0L as digest", "text")).collect()]
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([long])], ["doc", "digest", "text"])
        pieces = list(line_dedup._pieces(iter([batch])))
    finally:
        line_dedup.PIECE = piece
    assert sorted(numbers) == sorted([*range(60), 0, 0, 1, *range(60)])
    assert len(pieces) > 3 and "\n".join(p.column("text")[0].as_py() for p, _ in pieces) == long


def test_slices_part_a_long_text_from_others():
    texts = ["a", "b" * 50, "c" * 5000, "d", "e" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert [b.column("text").to_pylist() for b in slices(iter([batch]), "text", 1000)] == [texts[:2], texts[2:3], texts[3:]]


def test_recall_of_near_lines_on_documents(spark):
    """At least 0.9 of the pairs of lines whose edit similarity is 0.9 or more, found pair by pair, are found."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    docs = spark.read.parquet(path).select("doc_id", "text")
    first = {}
    for r in sorted(docs.collect()):
        for i, line in enumerate((r.text or "").split("\n")):
            first.setdefault(_form(line), (r.doc_id, i))
    first.pop("", None)
    forms = sorted(first, key=len)
    size, letters = np.array([len(f) for f in forms]), sorted(set("".join(forms)))
    counts = np.zeros((len(forms), len(letters)), np.int16)
    for i, f in enumerate(forms):
        for c, n in Counter(f).items():
            counts[i, letters.index(c)] = min(n, 30000)
    later = []
    for i in range(len(forms)):  # an edit changes two counts by one at most
        j = np.arange(i + 1, np.searchsorted(size, size[i] / 0.9 + 1e-6, "right"))
        j = j[np.abs(counts[j] - counts[i]).sum(1) <= 2 * (size[j] * 0.1 + 1e-9)]
        for k in j.tolist():
            if line_dedup.similar(forms[i], forms[k], 0.9):
                later.append(max(first[forms[i]], first[forms[k]]))
    kept = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(docs).where("text is not null").collect()}
    texts = {r.doc_id: r.text for r in docs.where("text is not null").collect()}
    found = [texts[d].split("\n")[i] not in kept[d] for d, i in later]
    assert len(later) > 200 and sum(found) >= 0.9 * len(later), (sum(found), len(later))


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == _distance(a, b, 99)


def test_near_lines_of_8_to_50_words_are_found(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 50))) for _ in range(240)]
    near = []
    for i, line in enumerate(base):
        if i % 2:  # letters, one at least
            letters = list(line)
            for at in rng.sample([k for k, c in enumerate(letters) if c != " "], max(1, len(line) // 33)):
                letters[at] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            near.append("".join(letters))
        else:  # whole words
            split = line.split(" ")
            for at in rng.sample(range(len(split)), max(1, len(split) // 15)):
                split[at] = rng.choice(words)
            near.append(" ".join(split))

    alike = [_distance(a, b, 999) <= int(max(len(a), len(b)) * 0.1 + 1e-9) for a, b in zip(base, near)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(base + near)), SCHEMA)).collect()}
    assert all(got[i] == line for i, line in enumerate(base))
    gone = [got[len(base) + i] == "" for i in range(len(base))]
    assert sum(alike) > 200 and not any(g and not a for g, a in zip(gone, alike))
    assert sum(g for g, a in zip(gone, alike) if a) >= 0.97 * sum(alike)


def test_all_lines_that_share_a_block_are_compared(spark):
    """Before, six blocks of a line were keys, and lines that shared others only were not compared."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    base, near = [], []
    for _ in range(120):
        line = [word() for _ in range(60)]
        base.append(" ".join(line))
        for at in range(rng.randint(0, 3), 60, 4):  # no run of four is left but one at the end
            if at < 54:
                line[at] = line[at][:3] + "0" + line[at][4:]
        near.append(" ".join(line))
    docs = spark.createDataFrame(list(enumerate(base + near)), SCHEMA)
    keys = {}
    for r in line_dedup.lines_of(docs.selectExpr("doc_id as doc", "0L as digest", "text").coalesce(1)).where("table is not null").collect():
        for node in np.frombuffer(r.table, line_dedup._NODE):
            keys.setdefault(int(node["id"]), []).append(node)
    assert len(keys) == 240 and all(sum(int(n["n"]) for n in nodes) == 57 for nodes in keys.values())
    by_line = {r.doc: keys[r.node] for r in line_dedup.lines_of(docs.selectExpr("doc_id as doc", "0L as digest", "text").coalesce(1)).collect()}
    apart = lambda x, y: sum(((int(x[c]) ^ int(y[c])) & (2**64 - 1)).bit_count() for c in ("sim", "turns"))
    want = [i for i in range(120) if apart(by_line[i][0], by_line[120 + i][0]) <= line_dedup.DISTANCE]
    assert len(want) > 60 and all(line_dedup.similar(base[i], near[i], 0.9) for i in want)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert all(got[120 + i] == "" for i in want) and all(got[i] == base[i] for i in range(120))


def test_pairs_that_a_leader_does_not_link_are_verified():
    """All near pairs of a bucket that are not in one group: before, only those with a leader."""
    rows = np.zeros(600, line_dedup._LABELLED)
    rows["key"], rows["id"], rows["label"], rows["size"] = np.arange(600) // 200, np.arange(600), np.arange(600), 100
    rows["label"][400:] = 7  # one group
    rows["sim"][::2] = 2**62 - 1  # far from the others
    rows["size"][:20] = 50
    rows["size"][20:40] = 91
    batch = pa.RecordBatch.from_arrays([pa.array([rows[i::3].tobytes() for i in range(3)], pa.binary())], ["rows"])
    some, line_dedup.PAIRS = line_dedup.PAIRS, 500
    try:
        got = [p for b in line_dedup._across(40, 0.9)(iter([batch])) for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist())]
    finally:
        line_dedup.PAIRS = some
    want = {(u, v) for u in range(400) for v in range(u) if u // 200 == v // 200 and (u - v) % 2 == 0 and min(rows["size"][[u, v]]) >= 0.9 * max(rows["size"][[u, v]])}
    assert len(got) == len(set(got)) and set(got) == want


def test_lines_without_blanks(spark):
    rng = random.Random(12)
    long = ["".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(40)), "".join(chr(rng.randint(0xE01, 0xE2E)) for _ in range(60)), "版权所有"]
    near = [line[:20] + "x" + line[21:] for line in long[:2]]
    rows = [(1, "\n".join(long)), (2, "\n".join(long + ["版权"])), (3, "\n".join(near + ["版权", "Read more"])), (4, "Read more\nабвгд\nабвгд")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _lines_kept(rows) and got[3] == "Read more"


# 6: quality


def test_isotonic_is_monotone_and_pools():
    total, good = np.array([0, 2, 2, 0, 4, 1, 0.0]), np.array([0, 2, 0, 0, 3, 1, 0.0])
    fit = quality.isotonic(total, good)
    assert (np.diff(fit) >= 0).all() and fit[1] == fit[2]
    assert (quality.isotonic(np.zeros(4), np.zeros(4)) == 0.5).all()


def test_quality(spark, clashing, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        text = _prose(rng, 80) + "." if good else " ".join(w.upper() + "!!" for w in _prose(rng, 60).split())
        rows.append((i, text))
        labels.append((i, int(good), 0))
    labels += [(7, None, None), (None, 1, 0), (10**6, 1, 0)]
    rows += [(400, None), (401, ""), (None, "a b")]
    df, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(300) if got[i].held_out]
    assert held == [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    again = {r.doc_id: r.score for r in quality.classify(df.repartition(7), marks).collect()}
    assert all(again[d] == r.score for d, r in got.items())
    assert {r.score for r in quality.classify(df, marks.limit(0)).collect()} == {0.5}
    assert quality.classify(clashing, marks).count() == clashing.count() and quality.classify(empty, marks).count() == 0


# 7: BPE


def test_bpe_is_the_librarys(spark, docs, empty, clashing):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(9)
    odd = " \n\t\x0b\x1c\x85\xa0abcXYZ019'st're²½ª×÷éßŁ漢字🙂 　ǅ٣Ⅷ.,!$"
    texts = [t or "" for _, t in ROWS] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["<|endoftext|>", "a<|endoftext|> b", "a" * 777, " " * 50, "=" * 333]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: r for r in bpe.encode_decode(df, vocabulary_path()).collect()}
    for i, e in enumerate(theirs.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == e.ids and got[i].n_tokens == len(e.ids)
        assert got[i].decoded == theirs.decode(e.ids, skip_special_tokens=False) == texts[i]
    digest = {r.doc_id: r for r in bpe.encode_digests(df, vocabulary_path()).collect()}
    assert all(digest[i].ids_sha256 == hashlib.sha256(got[i].ids).hexdigest() for i in got)
    assert bpe.encode_digests(empty, vocabulary_path()).count() == 0
    assert bpe.encode_digests(clashing, vocabulary_path()).count() == clashing.count()


def test_decode_of_broken_bytes():
    v = bpe.load(vocabulary_path())
    half = int(v.byte_ids[0xC3])
    assert bpe.decode(np.array([half, int(v.byte_ids[65])], "<u4").tobytes(), v) == "�A"


# 8: personal data


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _pii_brute(text):
    out = []
    for kind in pii.BASE:
        for m in re.finditer(pii.PLAIN[kind], text, re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, empty, clashing):
    rng = random.Random(12)
    texts = ["a@b.c_d@e.f.g..h@i", "x@y", "🙂é 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4539 1488 0343 6467", "4539-1488-0343-6467 9", "+49 (30) 1234-5678 +1-23", "+1 555", None, "", "7" * 5000, "a@" + "b." * 3000 + "c", "é" * 9 + "q@r.st"]
    alpha = "a1b2@.+- ()4539é_%"
    texts += ["".join(rng.choice(alpha) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in pii.report(df).collect():
        want = _pii_brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert [x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE] == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in pii.BASE]
    assert pii.report(empty).count() == 0 and pii.report(clashing).count() == clashing.count()


def test_pii_added_kinds(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "my SSN is 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [s.value for s in got[1].pii_iban] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"] and got[1].pii_iban[0].score == 1.0
    assert not got[2].pii_iban and not got[4].pii_ssn and [(s.start, s.end) for s in got[3].pii_ssn] == [(10, 21)]


# 9: near duplicates


def _near_brute(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {d: (len(sets[d]), label[d], d == label[d]) for d in sets}


@pytest.mark.parametrize("options", [{}, {"large": 2}, {"large": 2, "hot_members": 2}])
def test_near_duplicates(docs, options):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, **options).collect()}
    assert got == _near_brute(ROWS)
    assert sum(not kept for _, _, kept in got.values()) > 10


def test_near_duplicates_of_odd_tables(empty, clashing):
    assert minhash.near_duplicates(empty).count() == 0
    got = minhash.near_duplicates(clashing)
    assert got.count() == clashing.count() and got.where("doc_id is null and not kept").count() == 0


def test_overlaps_count_shared_tokens():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(90)]
    first = np.cumsum([0, *map(len, sets)])
    got = minhash.overlaps(np.concatenate(sets), first, slice(10, 50))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[10:50]]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 10: language model


def _katz_brute(rows):
    tokens = [(d, (t or "").encode().lower().split() + ["<e>"], zlib.crc32(str(d if d is not None else "").encode()) % 10 != 0) for d, t in rows]
    grams = [Counter(), Counter(), Counter()]
    for _, ts, train in tokens:
        if train:
            for h in zip(["<b>", "<b>", *ts], ["<b>", *ts], ts):
                for k in range(3):
                    grams[k][h[2 - k :]] += 1
    lost = [katz.losses([sum(1 for x in c.values() if x == r) for r in range(1, katz.K + 2)]) for c in grams]
    total = sum(grams[0].values())
    less = lambda c, k: c - lost[k][min(c, katz.K + 1) - 1]
    unknown = sum(c - less(c, 0) for c in grams[0].values()) / total
    follow, context = [defaultdict(list) for _ in range(3)], [Counter() for _ in range(3)]
    for k, counts in enumerate(grams):
        for g, c in counts.items():
            follow[k][g[:-1]].append(g[-1])
            context[k][g[:-1]] += c
    alphas = {}

    def p(h, w):  # h a tuple of at most two words
        k = len(h)
        c = grams[k].get((*h, w), 0)
        if c:
            return less(c, k) / context[k][h]
        if not k:
            return unknown
        if h not in follow[k]:
            return p(h[1:], w)
        if h not in alphas:
            alphas[h] = (1 - sum(p(h, x) for x in follow[k][h])) / (1 - sum(p(h[1:], x) for x in follow[k][h]))
        return alphas[h] * p(h[1:], w)

    vocabulary = [w for (w,) in grams[0]] + ["<unknown>"]
    for k in range(3):  # P(. | h) sums to 1
        for h in list(follow[k])[:20]:
            assert abs(sum(p(h, w) for w in vocabulary) - 1) < 1e-9
    out = []
    for d, ts, train in tokens:
        base = sum(math.log10((grams[0][(w,)] + 0.1) / (total + 0.1 * (len(grams[0]) + 1))) for w in ts)
        full = sum(math.log10(p((u, v), w)) for u, v, w in zip(["<b>", "<b>", *ts], ["<b>", *ts], ts))
        out.append((d, not train, len(ts), sum((w,) in grams[0] for w in ts), total, base, full))
    return out


@pytest.mark.parametrize("hot, buckets", [(katz.HOT, None), (20, 64), (1, 1)])
def test_katz(docs, hot, buckets):
    want = {r[0]: r for r in _katz_brute(ROWS)}
    got = {r.doc_id: tuple(r) for r in katz.scores(docs, buckets, hot).collect()}
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:5] == w[:5] and got[d][5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("buckets", [7, 1 << 14, 20_000, 100_000, 1 << 20])
def test_trigrams_are_sorted_by_bucket_whatever_their_number(buckets):
    rng = np.random.default_rng(buckets)
    h, w = (rng.integers(0, 2**63, 300, dtype=np.uint64)[rng.integers(0, 300, 5000)] for _ in "hw")
    bucket = (h + w % np.uint64(3)) % np.uint64(buckets)
    order = katz._by_bigram(bucket, h, w, buckets)
    assert sorted(order.tolist()) == list(range(5000)) and (np.diff(bucket[order].astype(np.int64)) >= 0).all()
    together = [k for k, (x, y) in enumerate(zip(h[order].tolist(), w[order].tolist())) if not k or (h[order][k - 1], w[order][k - 1]) != (x, y)]
    assert len(together) == len(set(zip(h.tolist(), w.tolist())))


def test_katz_of_odd_tables(spark, empty, clashing):
    assert katz.scores(empty).count() == 0
    rows = [tuple(r) for r in clashing.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    want, got = sorted(_katz_brute(rows), key=key), sorted((tuple(r) for r in katz.scores(clashing).collect()), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_what_travels_is_small_and_comes_back_whole():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(-9, 2**40, 50), np.zeros(0, np.int64), rng.integers(0, 99, 7).astype(np.int32), np.array([2**64 - 1], np.uint64), np.ones(3, np.uint8)]
    for a, b in zip(arrays, katz._unpacked(katz._packed(*arrays)), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)
    assert len(katz._packed(*[np.zeros(0, np.int64)] * 8)) < 60


def test_stored_tables_leave_no_exchanged_rows_behind(spark):
    ids = lambda: {b.toString() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if b.isShuffle()}
    before, setting = ids(), spark.conf.get(recovery.CLEANUP, None)
    with recovery.freed(spark):
        rows = spark.range(1000).repartition(3, "id").where("id >= 0")
        kept = recovery.stored(rows)
    end = time.time() + 20
    while ids() - before and time.time() < end:
        time.sleep(0.2)
    assert not ids() - before and kept.count() == 1000 and spark.conf.get(recovery.CLEANUP, None) == setting


def test_discounts():
    assert all(0 < d <= 1 for d in katz.discounts([100, 40, 25, 18, 13, 10]))
    assert all(0 < d < 1 for d in katz.discounts([0, 0, 0, 0, 0, 0]) + katz.discounts([1, 50, 0, 0, 0, 0]))


def test_quality_statistics_do_not_depend_on_batches():
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["one line", "a line of more words", "read on"]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    whole = quality.statistics(pa.array(texts))
    block, quality.BLOCK = quality.BLOCK, 400
    try:
        parts = quality.statistics(pa.array(texts))
    finally:
        quality.BLOCK = block
    again = [len(t.split("\n")) - len(set(t.split("\n"))) for t in texts]
    assert np.array_equal(whole, parts) and np.allclose(whole[:, -2], [n / len(t.split("\n")) for n, t in zip(again, texts)])


def test_few_edits_never_promises_too_much():
    rng = random.Random(7)
    words = ["a", "bb", "ccc", *[f"w{i}" for i in range(12)]]
    sure = 0
    for _ in range(2000):
        a = [rng.choice(words) for _ in range(rng.randint(1, 10))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice(["x", "yy", "bb", "bbb"])] if rng.random() < 0.6 or len(b) == 1 else []
        if line_dedup.few_edits(a, b, most := rng.randint(0, 8)):
            sure += 1
            assert line_dedup.edit_distance(" ".join(a), " ".join(b)) <= most
    text = [f"{rng.choice(words)}{i}" for i in range(400)]
    more = [w for i, w in enumerate(text) if i % 40] + ["an end"]
    calls, whole = [], line_dedup.edit_distance
    line_dedup.edit_distance = lambda x, y: calls.append(len(x)) or whole(x, y)
    try:
        assert line_dedup.similar(" ".join(text), " ".join(more), 0.9)
    finally:
        line_dedup.edit_distance = whole
    assert sure > 500 and sum(calls) < 200  # before, all of the two texts went through the table


@pytest.mark.parametrize("most", [0, 1, 2, 12, 63, 64, 65, 130])
def test_edit_distances_of_many_pairs_are_those_of_each(most):
    rng = random.Random(most)
    xs, ys = [], []
    while len(xs) < 60:
        letters = rng.choice(["ab", "abcdefgh ", "a\u00e9\u65e5\U0001f642"])
        x = [rng.choice(letters) for _ in range(rng.choice([1, 5, 63, 64, 65, 128, 300]))]
        y = list(x)
        for _ in range(rng.randint(0, most * 3 // 2 + 1)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        x, y = sorted(("".join(x), "".join(y)), key=len, reverse=True)
        if len(x) - len(y) <= most:
            xs.append(x)
            ys.append(y)
    for x, y, got in zip(xs, ys, line_dedup.edit_distances(xs, ys, most), strict=True):
        true = line_dedup.edit_distance(x, y)
        assert got == true if true <= most else got > most


def test_unlike_lines_share_one_table_of_edits():
    rng = random.Random(9)
    base = [_prose(rng, rng.randint(60, 80)).split(" ") for _ in range(60)]
    xs = [" ".join(b) for b in base]
    ys = [" ".join(rng.choice(WORDS) if rng.random() < share else w for w in b) for b, share in zip(base, [0.05, 0.1, 0.15, 0.3] * 15)]
    want = [line_dedup.similar(x, y, 0.9) for x, y in zip(xs, ys)]
    calls, whole = [], line_dedup.edit_distance
    line_dedup.edit_distance = lambda x, y: calls.append(len(x)) or whole(x, y)
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array(xs), pa.array(ys)], ["u", "v", "fu", "fv"])
        got = [u for b in line_dedup._similar(0.9)(iter([batch])) for u in b.column("u").to_pylist()]
    finally:
        line_dedup.edit_distance = whole
    assert 0 < sum(want) < 60 and got == [i for i, w in enumerate(want) if w] and not calls


@pytest.mark.parametrize("n", [64, 65, 4096, 4097, 600_000])
def test_a_word_has_its_hash_beside_very_long_ones_too(n):
    """Before, a word of more than 4,096 bytes changed the hashes of those around it."""
    got, first = hash_words(pa.array(["Foo bar " + "y" * n + " foo", "x" * n, "y" * n]))
    assert first.tolist() == [0, 4, 5, 6] and got[0] == got[3] == hash_words(pa.array(["foo"]))[0][0]
    assert got[1] == hash_words(pa.array(["bar"]))[0][0] and got[2] == got[5] != got[4]


def test_few_edits_finds_a_passage_put_into_a_text_whose_words_come_again():
    rng = random.Random(14)
    one = [rng.choice(WORDS) for _ in range(3000)]
    two = one[:1000] + [rng.choice(WORDS) for _ in range(100)] + one[1000:1400] + ["other"] + one[1402:]
    x, y = " ".join(one), " ".join(two)
    calls, whole = [], line_dedup.edit_distance
    line_dedup.edit_distance = lambda a, b: calls.append(len(a)) or whole(a, b)
    try:
        assert line_dedup.similar_pairs([x, y], [y, x], 0.9).tolist() == [True, True]
    finally:
        line_dedup.edit_distance = whole
    assert sum(calls) < 2000  # before, the two texts went through the table whole


def test_nodes_are_dealt_by_parts_with_all_their_keys(spark):
    """Texts are read once, and what goes to a part goes in few rows: before, each key was a row."""
    rng = random.Random(15)
    texts = ["\n".join(_prose(rng, rng.randint(1, 30)) for _ in range(40)) for _ in range(5)]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, digest long, text string").coalesce(1)
    lines = line_dedup.lines_of(docs)
    tables = lines.where("table is not null").select("table")
    nodes = np.concatenate([np.frombuffer(r.table, line_dedup._NODE) for r in tables.collect()])
    assert set(nodes["id"].tolist()) == {r.node for r in lines.select("node").collect()} and nodes["n"].min() >= 1
    rows = tables.mapInArrow(line_dedup._dealt(8), "part int, rows binary").collect()
    dealt = np.concatenate([np.frombuffer(r.rows, line_dedup._ROW) for r in rows])
    assert len(rows) <= 8 and all({int(k) % 2**64 % 8 for k in np.frombuffer(r.rows, line_dedup._ROW)["key"]} == {r.part} for r in rows)
    want = {(int(k), int(r["id"]), int(r["sim"]), int(r["turns"]), int(r["size"])) for r in nodes for k in r["keys"][: r["n"]]}
    assert {tuple(r) for r in dealt.tolist()} == want and len(dealt) == nodes["n"].sum()


def test_forms_are_normal_forms(spark):
    texts = ["A  b-C\n\n..É, d\t(X)  z\nlast", "日本  (Go!)"]
    asked = [[{"line_no": 2, "node": 7}, {"line_no": 0, "node": 8}], [{"line_no": 0, "node": 9}]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(asked, pa.list_(pa.struct([("line_no", pa.int32()), ("node", pa.int64())])))], ["text", "wanted"])
    (got,) = line_dedup._forms(iter([batch]))
    assert got.column("node").to_pylist() == [7, 8, 9]
    assert got.column("form").to_pylist() == [line_dedup.normal_form(x) for x in (texts[0].split("\n")[2], texts[0].split("\n")[0], texts[1])]
