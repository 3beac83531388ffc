"""Language-model scores by Katz backoff over trigrams, bigrams and unigrams.

Tokens are words (A-Z as a-z) and one end token for each text; begin marks precede the first.  With training counts c, and
losses l(r) = r (1 - d_r) of Good-Turing's discounts d_r for counts up to K, a small constant TOUCH for larger ones (each order
has its own):

    P(w | u v) = (c(u v w) - l) / c(u v)     where u v w was seen
               = alpha(u v) P(w | v)         where only u v was, and P(w | v) where u v was not
    P(w | v)   = (c(v w) - l) / c(v),  alpha(v) P(w)  or  P(w)   in the same way
    P(w)       = (c(w) - l) / N              where w was seen, else what the discounts leave, as one unknown word

alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of the same words' P(w | shorter h)) makes every P(. | h) sum to 1 exactly.  Plain
Katz takes nothing from counts above K; TOUCH leaves some mass to histories that have only such counts.

How it runs: counts of words are aggregated; the HOT most frequent words, a table of bounded size, are broadcast.  Every
task sends its trigrams, with the documents they stand in, to the bucket of their middle word as compressed columns (words by
rank in that table where they have one).  There both u v w and v w have exact counts, and what alpha needs of u v and of v are
sums over w: so a very frequent middle word is dealt over several buckets by the word after it, and the sums are added up.  c(u v)
is a history's count where v is the last word of the trigram before.  Each document gets the counts of its tokens back; what
depends on sums over the whole corpus (discounts, alpha) enters at the end: for seen n-grams through how many of a document's
have count r, for unseen ones, which only held-out texts have, through joins with tables of histories and words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import fold
from .recovery import freed, release, stored
from .text import hash_words, lean, mix, slices

K, HOT, TOUCH = 5, 1 << 16, 0.1
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
SLICE = 8 << 20
LEVEL = 4  # of compression, of what travels
PARTS = ("tokens", "known", "base", "rest")


def _named(letter: str, most: int = K + 1) -> list[str]:
    return [f"{letter}{r}" for r in range(1, most + 1)]


def discounts(n: list[int]) -> list[float]:
    """d_1 .. d_K from n_1 .. n_(K+1), the numbers of types with each count: Good-Turing's where it gives factors between 0 and 1;
    else absolute discounting by (n1 + 0.5) / (n1 + 2 n2 + 1)."""
    n = [*n, *[0] * (K + 1 - len(n))]
    if all(n):
        cut = (K + 1) * n[K] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if cut != 1 else 0 for r in range(1, K + 1)]
        if all(0 < x < 1 for x in d):
            return d
    less = (n[0] + 0.5) / (n[0] + 2 * n[1] + 1)
    return [(r - less) / r for r in range(1, K + 1)]


def losses(n: list[int]) -> list[float]:
    """What counts 1 .. K lose, and at last what larger counts do."""
    return [*(r * (1 - d) for r, d in enumerate(discounts(n), 1)), TOUCH]


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with the end token, and the index of each text's first."""
    words, first = hash_words(batch.column("text"))
    at = first[1:] + np.arange(batch.num_rows)
    out = np.empty(len(words) + batch.num_rows, np.uint64)
    own = np.ones(len(out), bool)
    own[at] = False
    out[own], out[at] = words, END
    return out, np.concatenate([[0], at + 1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, c) of training texts, combined over about a million distinct words."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        w, c = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(w, kind="stable")
        w, c = w[order], c[order]
        new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(w[new].view(np.int64)), pa.array(np.add.reduceat(c, new))], ["w", "c"])

    for batch in slices(batches, "text", SLICE):
        held.append(np.unique(_tokens(batch)[0], return_counts=True))
        n += len(held[-1][0])
        if n > 1 << 20:
            yield out()
            held, n = [], 0
    if n:
        yield out()


class Table:
    """The most frequent words, by falling count: hash, count, probability and how many buckets their trigrams are dealt over."""

    def __init__(self, words: list[tuple[int, int]], begins: int, total: int, p1, buckets: int):
        pairs = dict(words) | {int(BEGIN.view(np.int64)): begins}
        w, c = np.array(list(pairs), np.int64).view(np.uint64), np.array(list(pairs.values()), np.int64)
        order = np.lexsort((w, -c))
        self.w, self.c = w[order], c[order]
        self.at = np.argsort(self.w)
        self.sorted = self.w[self.at]
        self.p1 = np.where(self.w == BEGIN, 0.0, p1(self.c))
        self.deal = np.maximum(1, -(-self.c * buckets // max(total, 1))).astype(np.uint64)

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the table, or -1."""
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.at[at], -1).astype(np.int32)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: for each its type and length, then its bytes by significance."""
    parts = [bytes([len(arrays)])]
    for a in arrays:
        parts += [a.dtype.str.encode(), len(a).to_bytes(4, "little"), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n = np.dtype(raw[at : at + 3].decode()), int.from_bytes(raw[at + 3 : at + 7], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 7).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind))
        at += 7 + n * kind.itemsize
    return out


def _by_bigram(bucket: np.ndarray, h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """An order by bucket in which equal bigrams stand together; h and w are well mixed, and 25 bits of each do."""
    pair = (h >> np.uint64(39) << np.uint64(25)) | (w >> np.uint64(39))
    if buckets <= 1 << 14:  # bucket and pair in one number
        return np.argsort((bucket << np.uint64(50)) | pair, kind="stable")
    order = np.argsort(pair, kind="stable")
    return order[np.argsort(bucket[order], kind="stable")]


def _shifted(x: np.ndarray, first: np.ndarray, begin) -> np.ndarray:
    """What stands one place before, in each text; `begin` before its first."""
    out = np.concatenate([x[:1], x[:-1]])
    out[first[:-1]] = begin
    return out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _trigrams(table, buckets: int):
    """(bucket, payload): trigrams with the texts they stand in and how often, by bucket of their middle word."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Table = table.value
        begin = int(t.rank(np.array([BEGIN]))[0])
        for batch in slices(batches, "text", SLICE):
            hashes, first = _tokens(batch)
            w, mw = t.rank(hashes), mix(hashes)  # words by rank, or as -1 - index into the slice's rarer ones
            rarer, at = np.unique(hashes[w < 0], return_inverse=True)
            w[w < 0] = -1 - at
            del hashes, at
            v, mv = _shifted(w, first, begin), _shifted(mw, first, mix(np.array([BEGIN]))[0])
            u = _shifted(v, first, begin)
            bucket = mix(mv + mw % np.where(v >= 0, t.deal[np.maximum(v, 0)], np.uint64(1))) % np.uint64(buckets)
            order = _by_bigram(bucket, mv, mw, buckets)
            del mw, mv
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(first))
            u, v, w, doc, bucket = (x[order] for x in (u, v, w, doc, bucket))
            new = _starts(w, v, u, doc)
            n = np.minimum(np.diff(new, append=len(w)), 2**31 - 1).astype(np.int32)
            u, v, w, doc, bucket = (x[new] for x in (u, v, w, doc, bucket))
            ids, train = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "train"))
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            names, blobs = [], []
            for b in np.flatnonzero(np.diff(cut)):
                s = slice(cut[b], cut[b + 1])
                code = np.concatenate([u[s], v[s], w[s]])
                used, at = np.unique(-1 - code[code < 0], return_inverse=True)
                code[code < 0] = -1 - at
                low = ids[doc[s]].min()
                names.append(b)
                blobs.append(_packed(*np.split(code, 3), np.diff(rarer[used], prepend=np.uint64(0)), ids[doc[s]] - low, np.array([low]), n[s], train[doc[s]].astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "payload"])

    return rows


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    by: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
            by.setdefault(bucket, []).append(blob)
    return by


def _by_count(group: np.ndarray, c: np.ndarray, groups: int) -> list[np.ndarray]:
    """How many of each group's counts are 1, .. K, and more."""
    return list(np.bincount(group * (K + 2) + np.minimum(c, K + 1), minlength=groups * (K + 2)).reshape(groups, K + 2)[:, 1:].T)


def _met(table, buckets: int):
    """(bucket, kind, payload) for each bucket of trigrams: counts for documents (kind 0, by bucket of the document), and, for
    the whole corpus, the numbers of n-grams by count (1), histories of one word (2), their rarer seen words (3), unseen
    bigrams (4), histories of two words (5) and unseen trigrams (6)."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Table = table.value
        by = _by_bucket(batches)
        while by:
            bucket, blobs = by.popitem()
            parts = [_unpacked(b) for b in blobs]
            own = [np.cumsum(p[3], dtype=np.uint64) for p in parts]
            rare = np.unique(np.concatenate(own))
            names = np.concatenate([t.w, rare])
            local = [np.append(np.searchsorted(rare, x) + len(t.w), 0).astype(np.int32) for x in own]
            u, v, w = (np.concatenate([np.where(p[i] >= 0, p[i], at[-1 - np.minimum(p[i], -1)]) for p, at in zip(parts, local)]) for i in range(3))
            doc = np.concatenate([p[4] + p[5][0] for p in parts])
            n, train = (np.concatenate([p[i] for p in parts]) for i in (6, 7))
            del parts, blobs, own, local
            bits = len(names).bit_length()
            order = np.argsort((v.astype(np.int64) << 2 * bits) | (w.astype(np.int64) << bits) | u) if 3 * bits < 64 else np.lexsort((u, w, v))
            u, v, w, doc, n, train = (x[order] for x in (u, v, w, doc, n, train))
            del order
            learnt = n.astype(np.int64) * train
            tri, pair, word = _starts(v, w, u), _starts(v, w), _starts(v)
            c3, c2, cv = (np.add.reduceat(learnt, x) for x in (tri, pair, word))
            del learnt, train
            middle = v[word]
            cv = np.where(middle < len(t.w), np.append(t.c, 0)[np.minimum(middle, len(t.w))], cv)
            size = lambda x: np.diff(x, append=len(v))
            each3, each2, eachv = np.repeat(c3, size(tri)), np.repeat(c2, size(pair)), np.repeat(cv, size(word))
            out = [(bucket, 1, _packed(*(np.bincount(np.minimum(c, K + 2), minlength=K + 3) for c in (c3, c2))))]
            # to documents: counts of the trigram, of its last two words and, plus 1 or at the begin 0, of the middle one
            known = np.where(np.repeat(names[middle] == BEGIN, size(word)), 0, eachv + 1)
            # (in the trigrams' order, in which counts repeat; documents by their place in a list of each payload)
            ids, whose = np.unique(doc, return_inverse=True)
            to = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            listed = np.argsort(to, kind="stable")
            heads = np.searchsorted(to[listed], np.arange(buckets + 1))
            place = np.empty(len(ids), np.int32)
            place[listed] = np.arange(len(ids)) - heads[to[listed]]
            goes = to[whose]
            back = np.argsort(goes.astype(np.uint16) if buckets <= 1 << 16 else goes, kind="stable")
            cut = np.searchsorted(goes[back], np.arange(buckets + 1))
            ended = np.repeat(names[w[pair]] == END, size(pair)).astype(np.uint8)
            for b in np.flatnonzero(np.diff(cut)):
                i, some = back[cut[b] : cut[b + 1]], ids[listed[heads[b] : heads[b + 1]]]
                out.append((int(b), 0, _packed(np.diff(some, prepend=some[:1]), some[:1], place[whose[i]], each3[i], each2[i], ended[i], known[i], n[i])))
            del ids, whose, to, listed, heads, place, goes, back, known, ended, i, some
            # histories of one word, where a bigram is unseen or other buckets may have one
            dealt = (middle < len(t.w)) & (np.append(t.deal, 1)[np.minimum(middle, len(t.w))] > 1)
            in_word = np.searchsorted(word, pair, "right") - 1
            wanted = dealt | (np.bincount(in_word, c2 == 0, len(word)) > 0)
            inside = wanted[in_word] & (c2 > 0)
            after = w[pair]
            chance = np.where(inside & (after < len(t.w)), np.append(t.p1, 0.0)[np.minimum(after, len(t.w))], 0.0)
            counts = [x[wanted] for x in _by_count(in_word, c2, len(word))]
            out.append((bucket, 2, _packed(names[middle][wanted].view(np.int64), *counts, np.bincount(in_word, chance, len(word))[wanted], cv[wanted])))
            few = inside & (after >= len(t.w))
            out.append((bucket, 3, _packed(names[v[pair]][few].view(np.int64), names[after][few].view(np.int64))))
            bare = each2 == 0
            out.append((bucket, 4, _packed(names[v[bare]].view(np.int64), names[w[bare]].view(np.int64), doc[bare], n[bare])))
            # histories of two words, in the same way
            history = (v.astype(np.int64) << bits) | u if 2 * bits < 64 else (mix(names[u] + mix(names[v])) >> np.uint64(1)).astype(np.int64)
            in_pair, over = np.searchsorted(pair, tri, "right") - 1, dealt[np.searchsorted(word, tri, "right") - 1]
            asked = np.unique(history[tri][c3 == 0])
            keep = over | (asked[np.minimum(np.searchsorted(asked, history[tri]), len(asked) - 1)] == history[tri]) if len(asked) else over
            keep &= c3 > 0
            tri, c3, in_pair = tri[keep], c3[keep], in_pair[keep]
            heads, at = np.unique(history[tri], return_inverse=True)
            some = np.zeros(len(heads), np.int64)
            some[at] = tri
            key = mix(names[u[some]] + mix(names[v[some]])).view(np.int64)
            covered = np.zeros(len(heads), np.int64)
            np.add.at(covered, at, c2[in_pair])
            out.append((bucket, 5, _packed(key, *_by_count(at, c3, len(heads)), *_by_count(at, c2[in_pair], len(heads)), covered, eachv[some])))
            new = each3 == 0
            out.append((bucket, 6, _packed(mix(names[u[new]] + mix(names[v[new]])).view(np.int64), doc[new], n[new])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "kind", "payload"])

    return rows


def _returned(begins: int, unit: float):
    """For each document its tokens, known tokens, base score, the logarithms that no discount enters, and how many of its seen
    trigrams, and seen bigrams of unseen trigrams, have count r."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _by_bucket(batches)
        names = ["doc", *PARTS, *_named("t", K), *_named("b", K)]
        log = lambda x: np.log10(np.maximum(x, 1e-9))
        while by:
            parts = [_unpacked(b) for b in by.popitem()[1]]
            ids, at = np.unique(np.concatenate([np.cumsum(p[0]) + p[1][0] for p in parts]), return_inverse=True)
            lists = np.cumsum([0, *(len(p[0]) for p in parts)])
            at = np.concatenate([at[k + p[2]] for k, p in zip(lists, parts)])
            c3, c2, ended, cv, n = (np.concatenate([p[i] for p in parts]) for i in range(3, 8))
            del parts
            sums = lambda x: np.bincount(at, n * x, len(ids))
            end, word = ended == 1, cv > 0
            known = np.where(word, cv > 1, False).astype(np.int64) + np.where(end, begins > 0, False)
            base = np.where(word, log(cv - 0.9) - unit, 0.0) + np.where(end, math.log10(begins + 0.1) - unit, 0.0)
            lower = (c3 == 0) & (c2 > 0)
            rest = np.where(c3 > K, log(c3 - TOUCH), 0.0) - np.where(~end & (c2 > 0), log(c2), 0.0)
            rest += np.where(lower & (c2 > K), log(c2 - TOUCH), 0.0) - np.where(lower, log(cv - 1), 0.0)
            rest -= np.where(word, 0.0, math.log10(max(begins, 1)))  # the history of a first token
            hist = [sums(c3 == r) for r in range(1, K + 1)] + [sums(lower & (c2 == r)) for r in range(1, K + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, sums(1), sums(known), sums(base), sums(rest), *hist)], names)

    return rows


def _rows(met: DataFrame, kind: int, schema: str) -> DataFrame:
    """The rows packed under one kind."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("payload").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in _unpacked(blob)], names)

    return met.where(f"kind = {kind}").select("payload").mapInArrow(rows, schema)


def _threshold(counts: DataFrame, most: int) -> int:
    """A count that at most `most` words reach, from a histogram of 64 steps for each doubling."""
    step = F.floor(F.log2("c") * 64).cast("int")
    reach, above = 0, 2**63 - 1
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():  # 4,096 rows at most
        reach += r["n"]
        if reach > most:
            return above
        above = r["c"]
    return 1


def scores(docs: DataFrame, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Texts whose crc32(doc_id as text) modulo 10 is 0 are held out; the others train.  Null and blank texts have the end
    token only.  base_score is the contract's additive unigram score, score the model's log10 probability of the text.  A
    repeated row counts, and is scored, as often as it stands there.  hot bounds the broadcast table, not the model.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    # 64-bit ids name rows in what travels; where they don't, rows are numbered
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        docs = docs.withColumn("doc", F.col("doc_id").cast("long"))
    else:
        docs = stored(docs.withColumn("doc", F.monotonically_increasing_id()))
    docs = docs.withColumn("train", fold(F.col("doc_id"), 10) != 0)
    plain = docs.select("doc", "train", "text")
    counts = stored(plain.where("train").mapInArrow(_count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    got = counts.agg(F.sum("c"), F.count("*"), *[F.sum((F.col("c") == r).cast("long")) for r in range(1, K + 2)]).first()
    total, vocabulary, types = got[0] or 0, got[1], [x or 0 for x in got[2:]]
    begins = docs.where("train").count()
    lost1 = losses(types)
    unknown = sum(n * x for n, x in zip([*types[:K], vocabulary - sum(types[:K])], lost1)) / total if total else 1.0
    p1 = lambda c: np.where(c > 0, (c - np.array([0.0, *lost1])[np.minimum(c, K + 1)]) / max(total, 1), unknown)
    least = _threshold(counts, hot)
    frequent = [(r["w"], r["c"]) for r in counts.where(F.col("c") >= least).collect()]  # `hot` rows at most
    table = spark.sparkContext.broadcast(Table(frequent, begins, total + begins, p1, buckets))
    unit = math.log10(total + 0.1 * (vocabulary + 1))
    release(spark)
    with freed(spark):  # the exchanged trigrams are the most that is on disk at once
        met = plain.mapInArrow(_trigrams(table, buckets), "bucket int, payload binary").repartition(buckets, "bucket").mapInArrow(_met(table, buckets), "bucket int, kind int, payload binary")
        met = stored(met)
    release(spark)
    numbers = np.zeros((2, K + 3), np.int64)
    for r in met.where("kind = 1").select("payload").toLocalIterator():  # a few numbers for each bucket
        numbers += np.array(_unpacked(bytes(r["payload"])))
    lost3, lost2 = (losses(x[1 : K + 2].tolist()) for x in numbers)
    weighed = lambda letter, lost: sum(F.col(x) * v for x, v in zip(_named(letter), lost))
    longs = lambda names: ", ".join(f"{x} long" for x in names)
    # alpha(v), of words after which a held-out text has an unseen one
    chance = F.when(F.col("c").isNull(), unknown).otherwise((F.col("c") - F.element_at(F.array(*map(F.lit, lost1)), F.least(F.col("c"), F.lit(K + 1)).cast("int"))) / max(total, 1))
    one = _rows(met, 2, f"h long, {longs(_named('n'))}, mass double, after long").groupBy("h").agg(*[F.sum(x).alias(x) for x in _named("n")], F.sum("mass").alias("mass"), F.max("after").alias("after"))
    seen = _rows(met, 3, "h long, w long").join(counts, "w").groupBy("h").agg(F.sum(chance).alias("rare_mass"))
    free = F.lit(1.0) - F.col("mass") - F.coalesce("rare_mass", F.lit(0.0))
    one = one.where("after > 0").join(seen, "h", "left").select("h", F.log10(weighed("n", lost2) / F.col("after") / F.greatest(free, F.lit(1e-12))).alias("backoff"))
    bare = _rows(met, 4, "h long, w long, doc long, n int").join(one, "h", "left").join(counts, "w", "left").groupBy("doc").agg(F.sum(F.col("n") * (F.coalesce("backoff", F.lit(0.0)) + F.log10(chance))).alias("score"))
    # alpha(u v) c(u v): the documents have - log10 c(u v) already
    two = _rows(met, 5, f"h long, {longs(_named('n') + _named('m'))}, covered long, after long").groupBy("h").agg(*[F.sum(x).alias(x) for x in [*_named("n"), *_named("m"), "covered"]], F.max("after").alias("after"))
    two = two.select("h", F.log10(weighed("n", lost3) / ((F.col("after") - F.col("covered") + weighed("m", lost2)) / F.col("after"))).alias("backoff"))
    new = _rows(met, 6, "h long, doc long, n int").join(two, "h").groupBy("doc").agg(F.sum(F.col("n") * F.col("backoff")).alias("score"))
    back = met.where("kind = 0").select("bucket", "payload").repartition(buckets, "bucket")
    back = back.mapInArrow(_returned(begins, unit), "doc long, " + ", ".join(f"{x} double" for x in [*PARTS, *_named("t", K), *_named("b", K)]))
    logs = lambda letter, lost: sum(F.col(x) * math.log10(r - lost[r - 1]) for r, x in enumerate(_named(letter, K), 1))
    back = back.select("doc", *PARTS[:3], (F.col("rest") + logs("t", lost3) + logs("b", lost2)).alias("score"))
    sums = back.unionByName(bare, allowMissingColumns=True).unionByName(new, allowMissingColumns=True).groupBy("doc").agg(*[F.sum(c).alias(c) for c in (*PARTS[:3], "score")])
    heads = docs.select("doc", "doc_id", (~F.col("train")).alias("held_out"))
    return heads.join(sums, "doc").select("doc_id", "held_out", F.col("tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
