"""Near-duplicate groups: MinHash with tensored banding, exact verification, connected components.

Two small collections of SIDE bands of ROWS minhashes each are computed for a document; each of the SIDE x SIDE tables is
keyed by a pair (band of the first, band of the second).  A row travels only with each band of the first collection and is
given its SIDE table keys where it arrives.  2 * SIDE * ROWS minhashes so serve as many tables as plain banding
would need SIDE^2 * 2 * ROWS for.  A pair of similarity s is missed with probability below 2 (1 - s^ROWS)^SIDE: 1e-4 at 0.75.

Documents of equal shingle sets are one representative before any table is built.  In a bucket every member is verified
against the bucket's smallest id only; then, in buckets whose members still lie in several components, members of different
components are verified against each other, so no link between components is lost.  In large mixed buckets that happens by
counting the shared shingles of all members at once, within a task and without a row for each pair; buckets too large for a
task go through prefix filtering (two sets with enough overlap share one of their rarest shingles).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .recovery import only, release, stored
from .text import SMALL, hash_words, lean, mix, shingles, slices

WORDS, PERCENT = 5, 75
SIDE, ROWS = 12, 2
#: Mixed buckets of more members are refined by prefix filtering.
LARGE = 64
#: Bands of more members are grouped by aggregation and joins, which combine and split what one task need not hold.
HOT = 20_000

_rng = np.random.default_rng(1997)
_ODD = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their first index."""
    hashes, first = shingles(*hash_words(texts), k)
    parts = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
    return (np.concatenate(parts) if parts else hashes), np.cumsum([0, *map(len, parts)])


def bands(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32-bit hashes of the 2 x SIDE bands of each nonempty set; zeros for empty ones."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 2 * SIDE), np.uint32)
    if not len(full):
        return out
    at = first[:-1][full]
    for band in range(2 * SIDE):
        h = np.zeros(len(full), np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((sets ^ _XOR[i]) * _ODD[i], at)
        out[full, band] = mix(h) >> np.uint64(32)
    return out


def sketches(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands ARRAY<INT>): d1 and d2 are a 128-bit digest of the shingle set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL):
            sets, first = shingle_sets(batch.column("text"), k)
            n = np.diff(first)
            total = np.concatenate([[0], np.cumsum(mix(sets))]).astype(np.uint64)
            other = np.concatenate([[0], np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D)))]).astype(np.uint64)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 2 * SIDE), pa.array(bands(sets, first).ravel().view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *(pa.array((t[first[1:]] - t[first[:-1]]).view(np.int64)) for t in (total, other)), sketch], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(lean(rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<int>")


def sets_of(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(id, shingles ARRAY<BIGINT>)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL):
            sets, first = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))], ["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(lean(rows), "id long, shingles array<long>")


def _banded(reps: DataFrame) -> DataFrame:
    """(key, id, n, part, other): each representative under its SIDE bands of the first collection, with the bands of the second."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("bands")[i]) for i in range(SIDE)])
    return reps.select(F.explode(keys).alias("key"), F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "part", F.slice("bands", SIDE + 1, SIDE).alias("other"))


def _tables(banded: DataFrame) -> DataFrame:
    """(key, id, n, part): one row for each of the SIDE tables that a row of `_banded` stands for."""
    keys = F.transform("other", lambda b, j: F.xxhash64("key", j, b))
    return banded.select(F.explode(keys).alias("key"), "id", "n", "part")


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """All tables with several members in a partition of `_banded` rows: member ids, sizes, parts, and each table's first member."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    table = pa.Table.from_batches(parts)
    key, ident, n, part = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "id", "n", "part"))
    other = np.concatenate([np.asarray(c.flatten()) for c in table.column("other").chunks]).reshape(-1, SIDE)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    member = order[same[1:] | same[:-1]]  # rows whose band has another member
    if not len(member):
        return None
    sub = (other[member].view(np.uint32).astype(np.uint64) << np.uint64(8)) + np.arange(SIDE, dtype=np.uint64)
    sub = mix(mix(sub) + key[member].view(np.uint64)[:, None]).ravel()
    member = np.repeat(member, SIDE)
    order = np.argsort(sub, kind="stable")
    same = np.zeros(len(sub) + 1, bool)
    same[1:-1] = sub[order][1:] == sub[order][:-1]
    order = order[same[1:] | same[:-1]]
    if not len(order):
        return None
    first = np.append(np.flatnonzero(np.diff(sub[order].view(np.int64), prepend=~sub[order][:1].view(np.int64))), len(order))
    member = member[order]
    return ident[member], n[member], part[member], key[member], first


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): every member of a table with the table's smallest id."""
    if found := _gathered(batches):
        ident, _, _, _, first = found
        lead = np.repeat(np.minimum.reduceat(ident, first[:-1]), np.diff(first))
        pairs = np.unique(np.column_stack([ident, lead])[ident != lead], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _across(large: int, percent: int):
    """(u, v, null): members of a table in different parts, of fit sizes; (u, null, key): each member of a table of over `large`
    members in several parts, with its band."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gathered(batches)
        if not found:
            return
        ident, n, part, key, first = found
        at = first[:-1]
        mixed = (np.minimum.reduceat(part, at) != np.maximum.reduceat(part, at)) & (np.diff(first) > 2)
        pairs, wide = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for a, b in zip(at[mixed], first[1:][mixed]):
            if b - a > large:
                wide.append(np.column_stack([ident[a:b], key[a:b]]))
                continue
            i, j = np.nonzero((part[a:b, None] != part[None, a:b]) & (ident[a:b, None] > ident[None, a:b]) & (np.minimum(n[a:b, None], n[None, a:b]) * 100 >= np.maximum(n[a:b, None], n[None, a:b]) * percent) & (ident[a:b] != ident[a:b].min())[None, :])
            pairs.append(np.column_stack([ident[a + i], ident[a + j]]))
            if len(pairs) > 4096:
                pairs = [np.unique(np.concatenate(pairs), axis=0)]
        pairs, wide = np.unique(np.concatenate(pairs), axis=0), np.unique(np.concatenate(wide), axis=0)
        none = lambda x: pa.nulls(len(x), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(pairs[:, 0], wide[:, 0])), pa.concat_arrays([pa.array(pairs[:, 1]), none(wide)]), pa.concat_arrays([none(pairs), pa.array(wide[:, 1])])], ["u", "v", "key"])

    return rows


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets overlap enough."""
    pairs = stored(pairs)
    ids = stored(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct())
    sets = sets_of(only(docs, ids, "doc_id", "id"), k).dropDuplicates(["id"])
    left, right = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")), sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    return stored(pairs.join(right, "v").join(left, "u").where(both * 100 >= (F.size("su") + F.size("sv") - both) * percent).select("u", "v"))


def overlaps(tokens: np.ndarray, first: np.ndarray, rows: slice) -> np.ndarray:
    """Sizes of the intersections of the sets in rows with all sets, a matrix; sets are runs of distinct tokens."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    start = np.flatnonzero(np.concatenate([[True], np.diff(tokens[order].view(np.int64)) != 0])) if len(tokens) else np.zeros(0, int)
    size = np.diff(start, append=len(tokens))
    out = np.zeros((rows.stop - rows.start, n), np.float32)
    common = np.flatnonzero(size > 32)
    for i in range(0, len(common), 512):  # frequent tokens: products of 0/1 matrices
        some = common[i : i + 512]
        hit = np.zeros((n, len(some)), np.float32)
        hit[owner[np.concatenate([np.arange(start[t], start[t] + size[t]) for t in some])], np.repeat(np.arange(len(some)), size[some])] = 1
        out += hit[rows] @ hit.T
    rare = np.flatnonzero((size > 1) & (size <= 32))
    for k in np.unique(size[rare]):  # the others: their pairs, as many tokens of one count at a time
        lists = owner[start[rare[size[rare] == k]][:, None] + np.arange(k)]
        for a in range(k):
            inside = np.flatnonzero((lists[:, a] >= rows.start) & (lists[:, a] < rows.stop))
            np.add.at(out, (np.repeat(lists[inside, a] - rows.start, k), lists[inside].ravel()), 1)
    return out


def _linked(percent: int, block: int = 512):
    """(u, v): links that join parts, among the members of each band (key, id, n, part, bands, shingles).

    A pair is looked at in the first band that it shares; of links between the same parts one is enough.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).sort_by([("key", "ascending"), ("id", "ascending")])
        key, ident, n, part = (table.column(c).to_numpy() for c in ("key", "id", "n", "part"))
        bands = np.concatenate([np.asarray(c.flatten()) for c in table.column("bands").chunks]).reshape(len(key), -1)[:, :SIDE]
        for a, b in zip(*(lambda s: (s, np.append(s[1:], len(key))))(np.flatnonzero(np.diff(key, prepend=~key[:1])))):
            lists = table.column("shingles").slice(a, b - a).combine_chunks()
            first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            tokens = np.asarray(lists.flatten()).view(np.uint64)
            index = next(i for i in range(SIDE) if (bands[a:b, i] == bands[a, i]).all())  # the band they are gathered by
            label = {int(p): int(p) for p in np.unique(part[a:b])}

            def root(x: int) -> int:
                while label[x] != x:
                    label[x] = label[label[x]]
                    x = label[x]
                return x

            out = []
            for i in range(a, b, block):
                j = min(i + block, b)
                both = overlaps(tokens, first, slice(i - a, j - a)).astype(np.int64)
                close = (both * 100 >= (n[i:j, None] + n[None, a:b] - both) * percent) & (part[i:j, None] != part[None, a:b]) & (ident[i:j, None] > ident[None, a:b])
                for before in range(index):
                    close &= bands[i:j, before][:, None] != bands[a:b, before][None, :]
                for x, y in zip(*np.nonzero(close)):
                    p, q = root(int(part[i + x])), root(int(part[a + y]))
                    if p != q:
                        label[max(p, q)] = min(p, q)
                        out.append((ident[i + x], ident[a + y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(out, np.int64).T], ["u", "v"])

    return rows


def _crossing(reps: DataFrame, hot: DataFrame, docs: DataFrame, large: int, percent: int, k: int) -> DataFrame:
    """Verified links between parts, within tables, beyond those with the table's smallest id."""
    banded = _banded(reps)
    found = stored(banded.join(hot, "key", "left_anti").repartition("key").mapInArrow(lean(_across(large, percent)), "u long, v long, key long"))
    links = _verified(found.where("v is not null").select("u", "v").distinct(), docs, percent, k)
    wide = stored(found.where("v is null").select(F.col("u").alias("id"), "key").distinct())
    if not wide.isEmpty():
        ids = stored(wide.select("id").distinct())
        about = reps.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "part", "bands")
        members = sets_of(only(docs, ids, "doc_id", "id"), k).dropDuplicates(["id"]).join(about, "id").join(wide, "id")
        links = links.union(stored(members.select("key", "id", "n", "part", "bands", "shingles").repartition("key").mapInArrow(lean(_linked(percent)), "u long, v long")))
    return links if hot.isEmpty() else links.union(_verified(_hot_pairs(banded.join(hot, "key", "left_semi"), docs, percent, k), docs, percent, k))


def _hot_pairs(banded: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs of members of mixed hot tables that share one of the shingles that are rarest among them.

    Two sets that overlap enough share one of the first n - ceil(n * percent / 100) + 1 shingles in any common order.
    """
    member = _tables(banded)
    mixed = member.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    wide = stored(member.join(mixed, "key", "left_semi").select("id", "part", F.col("n").alias("n_shingles")).distinct())
    near = (F.col("pu") != F.col("pv")) & (F.col("u") > F.col("v")) & (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    token = sets_of(only(docs, wide, "doc_id", "id"), k).dropDuplicates(["id"]).join(wide, "id").select("id", "part", "n_shingles", F.explode("shingles").alias("token"))
    token = token.join(token.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    lists = token.groupBy("id", "part", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    prefix = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    token = stored(lists.select("id", "part", "n_shingles", F.explode(F.slice("t", F.lit(1), prefix.cast("int"))).alias("t")).where("t.df > 1").select("id", "part", "n_shingles", "t.token"))
    split = token.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
    token = token.join(split, "token")
    a = token.select("token", F.col("id").alias("u"), F.col("part").alias("pu"), F.col("n_shingles").alias("nu"))
    b = token.select("token", F.col("id").alias("v"), F.col("part").alias("pv"), F.col("n_shingles").alias("nv"))
    return a.join(b, "token").where(near).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, large: int = LARGE, hot_members: int = HOT) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id, kept).

    Links have 100 * intersection >= percent * union of their sets of distinct k-word shingles; component_id is the smallest
    doc_id that links reach.  Texts without words (null, empty, blank) have no shingles and are linked with nothing.  A text
    of fewer than k words has one shingle.  Rows of the same doc_id share a component only by their texts; a null doc_id is kept alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _grouped(docs, percent, k, large, hot_members)
    # ids that name several rows can't stand for a text: rows are numbered, and groups get the smallest of their ids afterwards
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    named = rows.where("doc_id is not null")
    found = _grouped(named.select(F.col("_row").alias("doc_id"), "text"), percent, k, large, hot_members)
    found = named.select("_row", F.col("doc_id").alias("_id")).join(found, F.col("_row") == F.col("doc_id")).drop("_row", "doc_id")
    found = stored(found)
    smallest = found.groupBy("component_id").agg(F.min("_id").alias("_least")).withColumnRenamed("component_id", "_group")
    out = found.join(smallest, F.col("component_id") == F.col("_group")).select(F.col("_id").alias("doc_id"), "n_shingles", F.col("_least").alias("component_id"), (F.col("_id") == F.col("_least")).alias("kept"))
    return out.union(_grouped(rows.where("doc_id is null").select("doc_id", "text"), percent, k, large, hot_members))


def _grouped(docs: DataFrame, percent: int, k: int, large: int, hot_members: int) -> DataFrame:
    """The groups of documents whose ids, but for null, are unique."""
    spark = docs.sparkSession
    sketch = stored(sketches(docs, k))
    reps = stored(sketch.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    banded = _banded(reps.withColumn("part", F.col("rep")))
    hot = stored(banded.groupBy("key").agg(F.count("*").alias("members")).where(f"members > {hot_members}").select("key"))
    stars = banded.join(hot, "key", "left_anti").repartition("key").mapInArrow(lean(_stars), "u long, v long")
    tables = _tables(banded.join(hot, "key", "left_semi"))
    leads = tables.groupBy("key").agg(F.min("id").alias("v"))
    stars = stars.union(tables.join(leads, "key").where("id <> v").select(F.col("id").alias("u"), "v")).distinct()
    edges = _verified(stars, docs, percent, k)
    release(spark)
    parts = stored(components(edges))
    more = _crossing(reps.join(parts, F.col("rep") == F.col("id"), "left").withColumn("part", F.coalesce("component", "rep")), hot, docs, large, percent, k)
    release(spark)
    if not more.isEmpty():
        parts = components(edges.union(more))
    group = reps.select("d1", "d2", "rep").join(parts, F.col("rep") == F.col("id"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.join(group, ["d1", "d2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
