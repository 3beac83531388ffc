"""Vector best-fit: against a plain loop over bins, and on tables with nulls, empty and long texts and repeated rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import packing
from helixframe.llm.queries import vocabulary_path
from tests.llm.test_operators import ROWS, clashing, docs, empty  # noqa: F401  fixtures


def _plain(lengths, capacity, weights, rule):
    """The same choice, item by item, over all bins."""
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        take = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, take)):
                if rule == "norm":
                    v = sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, left, take, capacity))
                else:
                    v = -sum(w * (x / c) * (y / c) for w, x, y, c in zip(weights, left, take, capacity))
                if best is None or v < best[0] - 1e-15:
                    best = (v, b)
        if best is None:
            bins.append(list(capacity))
            best = (0, len(bins) - 1)
        out[i] = best[1]
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], take)]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("rule", packing.RULES)
@pytest.mark.parametrize("capacity", [(64, 64, 4096), (64, 4, 4096), (64, 64, 1200), (64, 5, 900)])
def test_best_fit_is_the_plain_loop(rule, capacity):
    rng = random.Random(4)
    lengths = np.array([min(rng.randint(1, 29), rng.randint(1, 29)) for _ in range(400)])
    where, offset = packing.best_fit(lengths, capacity, (1.0, 0.5, 0.25), rule)
    assert where.tolist() == _plain(lengths.tolist(), capacity, (1.0, 0.5, 0.25), rule)
    for b in np.unique(where):
        at = np.flatnonzero(where == b)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == [0, *np.cumsum(lengths[at])[:-1]]
        assert lengths[at].sum() <= capacity[0] and len(at) <= capacity[1] and (lengths[at] ** 2).sum() <= capacity[2]


def test_best_fit_of_nothing_and_of_pieces_beyond_a_capacity():
    assert [len(x) for x in packing.best_fit(np.zeros(0, int), (8, 8, 64))] == [0, 0]
    where, _ = packing.best_fit(np.array([7, 7, 1]), (8, 8, 16), packing.WEIGHTS)
    assert len(set(where.tolist())) == 3
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1]), (8, 8, 64), packing.WEIGHTS, "worst")


def _sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    return {s: sorted(x, key=lambda r: r.offset) for s, x in by.items()}


@pytest.mark.parametrize("shard", [packing.SHARD, 20])
def test_pieces_and_sequences(docs, shard):  # noqa: F811
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary_path())
    want = {i: [*theirs.encode(t or "", add_special_tokens=False).ids, 0] for i, t in ROWS}
    rows = packing.pack(packing.pieces(docs, vocabulary_path(), 100), 100, shard=shard).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by.keys() == want.keys()
    for i, parts in by.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 100 for r in parts[1:])
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts[:-1]]]).tolist()
        assert np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist() == want[i]
        assert len(parts) == -(-len(want[i]) // 100)
    packed = _sequences(rows)
    for parts in packed.values():
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts[:-1]]]).tolist()
        assert sum(r.length for r in parts) <= 100
    least = -(-sum(map(len, want.values())) // 100)
    assert len(packed) <= 1.03 * least if shard > 100 else len(packed) <= 1.1 * least


def test_bounds_on_documents_and_attention(docs):  # noqa: F811
    items = packing.pieces(docs, vocabulary_path(), 100)
    for rows in (packing.pack(items, 100, documents=2).collect(), packing.pack(items, 100, attention=10_000, documents=2, rule="dot").collect()):
        assert all(len(parts) <= 2 and sum(r.length for r in parts) <= 100 for parts in _sequences(rows).values())
    rows = packing.pack(items, 100, attention=5_000).collect()
    assert all(len(parts) == 1 or sum(r.length**2 for r in parts) <= 5_000 for parts in _sequences(rows).values())


def test_digests_and_odd_tables(clashing, empty):  # noqa: F811
    cut = packing.pieces(clashing, vocabulary_path()).withColumn("ids_crc32", F.crc32("ids"))
    rows = packing.pack(cut).collect()
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in rows)
    assert sum(r.piece == 0 for r in rows) == clashing.count()
    none = packing.pack(packing.pieces(empty, vocabulary_path()))
    assert none.count() == 0 and none.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    with pytest.raises(ValueError):
        packing.pack(cut, 0)
