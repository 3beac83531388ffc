"""Phrase collocations: runs of words that stand together far more often than their parts do apart.

Phrases of 2 to LONGEST words that occur LEAST times or more are found level by level (no phrase is more frequent than a part
of it) and counted by double-array tries:

1. Words are counted by language.  Texts become streams of codes, one for each frequent word of a language, 0 where no phrase
   can pass: at rare words, separators and ends of texts.
2. Pairs of neighbouring codes, and then longer runs all of whose pairs are frequent, are the candidates.  Tasks send the runs
   that they hold, once each, in compressed columns to buckets of their hashes; those that come too seldom stay there.
3. Candidates go into double-array tries of at most TRIE phrases each, which are broadcast one after the other.  All positions of
   a stream hold the state of the phrase that begins there; every level moves all of them at once and drops those that have no
   way on, and accepting states are counted by bincount.  Sums over the shards of the corpus are the phrases' frequencies.

What is broadcast: codes of the KNOWN most frequent words (others, if there are more, have a hash of 64 bits for a code), up to
SAFE hashes of frequent pairs (if there are more, longer runs of any pairs are dealt), one trie at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recovery import stored, written
from .text import LOWER, hash_spans, mix, slices, utf8, word_bounds

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Language of texts that have none.
NO_LANG = "und"
KNOWN, SAFE, TRIE = 1 << 22, 1 << 22, 1 << 18
SLICE, HELD = 8 << 20, 1 << 21
#: Rows of a side that is broadcast in the joins of phrases with their parts.
BROADCAST_PHRASES = 200_000
#: How many parts the candidates of a language are ranked in before their first ones meet.
SALTS = 64

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\n\x0b\x0c\r")] = True
_CLEAN = LOWER.copy()
_CLEAN[_SEPARATOR] = 32
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Words:
    """The words of a batch (lang, text): bounds, text and key (a hash of language and word) of each, and where no phrase passes."""

    def __init__(self, batch: pa.RecordBatch):
        raw, offsets = utf8(batch.column("text"))
        self.data = _CLEAN[raw]
        self.starts, self.ends, first = word_bounds(self.data, offsets)
        self.of = np.repeat(np.arange(batch.num_rows), np.diff(first))
        langs = batch.column("lang").dictionary_encode()
        self.names = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[self.of]
        salt = mix(np.array([_lang_hash(x) for x in self.names.to_pylist()], np.uint64))
        key = mix(hash_spans(self.data, self.starts, self.ends) ^ salt[self.lang]) if len(self.starts) else np.zeros(0, np.uint64)
        self.key = np.where(key == 0, np.uint64(1), key)
        marks = np.concatenate([[0], np.cumsum(_SEPARATOR[raw], dtype=np.int32)])
        self.apart = np.ones(len(self.starts), bool)  # from the word before
        self.apart[1:] = (marks[self.starts[1:]] != marks[self.ends[:-1]]) | (self.of[1:] != self.of[:-1])

    def spelled(self, at: np.ndarray) -> pa.Array:
        """The words at some places, in lower case."""
        n = self.ends[at] - self.starts[at]
        offsets = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n) + np.repeat(self.starts[at], n)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[place]))]).cast(pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, word, n) of a slice's words, and one row of key 0 for all words of a language."""
    for batch in slices(batches, "text", SLICE):
        words = _Words(batch)
        if not len(words.key):
            continue
        key, at, n = np.unique(words.key, return_index=True, return_counts=True)
        all_of = np.bincount(words.lang, minlength=len(words.names))
        langs = words.names.take(pa.array(np.concatenate([words.lang[at], np.arange(len(words.names))])))
        spelled = pa.concat_arrays([words.spelled(at), pa.array([""] * len(words.names), pa.string())])
        yield pa.RecordBatch.from_arrays([langs, pa.array(np.concatenate([key.view(np.int64), np.zeros(len(words.names), np.int64)])), spelled, pa.array(np.concatenate([n, all_of]))], ["lang", "key", "word", "n"])


def _blob(codes: np.ndarray) -> bytes:
    """Codes, compressed: bytes of equal weight stand together."""
    planes = np.ascontiguousarray(codes.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(codes).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _codes(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _streams(table):
    """(codes): one stream for each slice; words outside the table have code 0, or, where it is not complete, a negative hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, complete = table.value
        for batch in slices(batches, "text", SLICE):
            words = _Words(batch)
            if not len(words.key):
                continue
            at = np.minimum(np.searchsorted(known, words.key), max(len(known) - 1, 0))
            found = known[at] == words.key if len(known) else np.zeros(len(at), bool)
            other = np.int64(0) if complete else -1 - (words.key >> np.uint64(1)).view(np.int64)
            code = np.where(found, at + 1, other)
            gaps = np.flatnonzero(words.apart[1:]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([_blob(np.insert(code, gaps, 0))], pa.binary())], ["codes"])

    return rows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for blob in batch.column("codes"):
            yield _codes(blob.as_py())


def _hashed(run: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of codes."""
    out = np.zeros(len(run), np.uint64)
    for column in run.T:
        out = mix(out * _ODD + np.ascontiguousarray(column).view(np.uint64))
    return out


def _distinct(run: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows once each, sums of their counts, their hashes), in order of the hashes."""
    h = _hashed(run)
    order = np.argsort(h, kind="stable")
    run, h = run[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]).any(axis=1)])[: len(run)])
    return run[new], np.add.reduceat(n[order], new) if len(new) else n, h[new]


def _pairs(codes: np.ndarray) -> Iterator[np.ndarray]:
    at = np.flatnonzero((codes[:-1] != 0) & (codes[1:] != 0))
    yield codes[at[:, None] + np.arange(2)]


def _longer(safe: np.ndarray | None, longest: int):
    """Runs of 3 to `longest` codes all of whose pairs are among the safe ones, given by sorted hashes, or are any pairs."""

    def runs(codes: np.ndarray) -> Iterator[np.ndarray]:
        at = np.flatnonzero((codes[:-1] != 0) & (codes[1:] != 0))
        if safe is not None:
            at = at[_among(safe, _hashed(codes[at[:, None] + np.arange(2)]))]
        fit = np.zeros(len(codes) + longest, bool)
        fit[at] = True
        begin = fit
        for m in range(3, longest + 1):
            begin = begin[:-1] & fit[m - 2 :]  # the run goes on for one pair more
            i = np.flatnonzero(begin)
            if not len(i):
                return
            yield codes[i[:, None] + np.arange(m)]

    return runs


def _dealt(runs, buckets: int):
    """(bucket, m, payload): a task's runs of m codes and how often each comes, by ranges of their hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for m, parts in held.items():
                run, n, h = _distinct(*map(np.concatenate, zip(*parts)))
                cut = np.searchsorted(((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(cut))
                blobs = [_blob(np.concatenate([n[a:b], run[a:b].T.ravel()])) for a, b in zip(cut[some].tolist(), cut[some + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), m, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "m", "payload"])

        for codes in _read(batches):
            for run in runs(codes):
                held.setdefault(run.shape[1], []).append(_distinct(run, np.ones(len(run), np.int64))[:2])
                size += len(held[run.shape[1]][-1][1])
            if size > HELD:
                yield from out()
                held, size = {}, 0
        yield from out()

    return rows


def _often(least: int):
    """(words ARRAY<BIGINT>): the runs that come `least` times or more in all payloads of a bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for bucket, m, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "m", "payload"))):
                by.setdefault((bucket, m), []).append(blob)
        while by:
            (_, m), blobs = by.popitem()
            parts = [_codes(b).reshape(m + 1, -1) for b in blobs]
            run, n, _ = _distinct(np.concatenate([p[1:].T for p in parts]), np.concatenate([p[0] for p in parts]))
            run = run[n >= least]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(run) + 1, dtype=np.int32) * m), pa.array(run.ravel()))], ["words"])

    return rows


def _frequent_runs(streams: DataFrame, runs, least: int) -> DataFrame:
    """(words): runs of the streams that come `least` times or more, stored."""
    buckets = 2 * int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = streams.mapInArrow(_dealt(runs, buckets), "bucket int, m int, payload binary")
    return stored(dealt.repartition(buckets, "bucket").mapInArrow(_often(least), "words array<bigint>"))


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class DoubleArray:
    """A trie of phrases of codes in two arrays: the state after `state` and symbol c is base[state] + c where check is state.

    Symbols are the places, from 1, of codes in `alphabet`.  State 0 is the root.  `phrase` has the phrase that a state
    accepts, or -1.
    """

    def __init__(self, flat: np.ndarray, n: np.ndarray, seed: int = 5):
        """Phrases of n codes each, all in a row in `flat`."""
        self.alphabet, symbol = np.unique(flat, return_inverse=True)
        grid = np.zeros((len(n), max(n, default=1)), np.int64)
        grid[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = symbol + 1
        room = len(self.alphabet) + 1
        self.base, self.check, self.phrase = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        self._taken, self._rng = np.ones(room, bool), np.random.default_rng(seed)
        state = np.zeros(len(n), np.int64)
        for level in range(grid.shape[1]):
            on = np.flatnonzero(grid[:, level])
            edges, edge = np.unique(state[on] * room + grid[on, level], return_inverse=True)
            state[on] = self._placed(edges // room, edges % room)[edge]
            ends = on[n[on] == level + 1]
            self.phrase[state[ends]] = ends
        leaves = np.ones(len(self.base), bool)
        leaves[self.check[self.check >= 0]] = False
        self.base[leaves] = len(self.base)  # past all states, where nothing checks
        self.check, self.phrase = (np.append(x, np.full(room, -1, np.int32)) for x in (self.check, self.phrase))
        del self._taken, self._rng

    def _placed(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States for new edges, given in order of (parent, symbol)."""
        first = np.flatnonzero(np.diff(parent, prepend=-1))
        size = np.diff(first, append=len(parent))
        base = np.zeros(len(first), np.int64)
        below = parent[first] != 0  # the root's own base is 0
        for k in np.unique(size[below])[::-1].tolist():  # parents of many children first
            nodes = np.flatnonzero(below & (size == k))
            base[nodes] = self._fitted(symbol[first[nodes][:, None] + np.arange(k)])
        state = np.repeat(base, size) + symbol
        self.base[parent[first]] = base
        self.check[state] = parent
        return state

    def _fitted(self, symbols: np.ndarray) -> np.ndarray:
        """A base for each row of ascending symbols, so that all cells of all rows are free and distinct; they are taken then.

        All rows still without one try free cells at random for their first symbol, the fewer rows the more cells; those that
        find one at which all their cells are free, and wanted by no row before them, have it.  There are three times as many
        free cells as are needed, and some more after each round in which nearly all rows fail.
        """
        rows, k = symbols.shape
        base, wanting = np.zeros(rows, np.int64), np.arange(rows)
        need = 3 * rows * k
        while len(wanting):
            free = np.flatnonzero(~self._taken)
            if len(free) < need:
                more = need - len(free) + int(symbols[:, -1].max())
                self.base = np.append(self.base, np.zeros(more, np.int32))
                self.check, self.phrase = (np.append(x, np.full(more, -1, np.int32)) for x in (self.check, self.phrase))
                self._taken = np.append(self._taken, np.zeros(more, bool))
                free = np.flatnonzero(~self._taken)
            tries = max(1, min(4096, (1 << 19) // (len(wanting) * k)))
            at = free[self._rng.integers(0, len(free), (len(wanting), tries))] - symbols[wanting, :1]
            ok = (at >= 0) & (at + symbols[wanting, -1:] < len(self._taken))
            row, attempt = np.nonzero(ok)
            ok[row, attempt] = ~self._taken[at[row, attempt][:, None] + symbols[wanting[row]]].any(axis=1)
            trying = np.flatnonzero(ok.any(axis=1))
            at = at[trying, ok[trying].argmax(axis=1)]
            cells = at[:, None] + symbols[wanting[trying]]
            _, earliest = np.unique(cells.ravel(), return_index=True)
            won = np.bincount(earliest // k, minlength=len(trying)) == k
            base[wanting[trying[won]]] = at[won]
            self._taken[cells[won].ravel()] = True
            if won.sum() * 8 < len(wanting):
                need = max(need, len(free)) + len(free) // 16 + 4 * k
            wanting = np.delete(wanting, trying[won])
        return base

    def count(self, codes: np.ndarray) -> np.ndarray:
        """How often each state is reached from the positions of a stream, by the walk that begins there."""
        place = np.minimum(np.searchsorted(self.alphabet, codes), max(len(self.alphabet) - 1, 0))
        symbol = np.where(self.alphabet[place] == codes, place + 1, 0) if len(self.alphabet) else np.zeros(len(codes), np.int64)
        position, state = np.flatnonzero(symbol), np.int64(0)
        seen = np.zeros(len(self.check), np.int64)
        while len(position):
            to = self.base[state] + symbol[position]
            on = self.check[to] == state
            state, position = to[on], position[on] + 1
            seen += np.bincount(state, minlength=len(seen))
            inside = position < len(symbol)
            inside[inside] = symbol[position[inside]] > 0
            state, position = state[inside], position[inside]
        return seen


def _counted(table):
    """(id, n): how often a task's streams reach the accepting states of a trie, by the id of the phrase."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ids = table.value
        seen = np.zeros(len(trie.check), np.int64)
        for codes in _read(batches):
            seen += trie.count(codes)
        at = np.flatnonzero((seen > 0) & (trie.phrase >= 0))
        yield pa.RecordBatch.from_arrays([pa.array(ids[trie.phrase[at]]), pa.array(seen[at])], ["id", "n"])

    return rows


def _frequencies(streams: DataFrame, candidates: DataFrame, trie: int) -> DataFrame:
    """(words, a) of the candidates (words): exact counts, by one trie after the other."""
    spark = streams.sparkSession
    candidates = stored(candidates.select("words", F.monotonically_increasing_id().alias("_id")))
    shards = -(-candidates.count() // trie)
    shards = shards if shards < 2 else -(-4 * shards // 3)  # rows are dealt by hash: three quarters of the bound, so that none passes it
    sums = None
    for k in range(max(1, shards)):
        own = candidates.where(F.pmod(F.xxhash64("_id"), F.lit(shards)) == k) if shards > 1 else candidates
        got = own.toArrow()  # `trie` rows at most
        words = got.column("words").combine_chunks()
        table = spark.sparkContext.broadcast((DoubleArray(np.asarray(words.flatten()), np.asarray(words.value_lengths()).astype(np.int64)), got.column("_id").to_numpy()))
        del got, words
        found = stored(streams.mapInArrow(_counted(table), "id long, n long").groupBy("id").agg(F.sum("n").alias("a")))
        table.unpersist()
        sums = found if sums is None else sums.union(found)
    return candidates.join(sums, candidates["_id"] == sums["id"]).select("words", "a")


def _column(df: DataFrame) -> np.ndarray:
    """The only column, of whole numbers, on the driver."""
    return df.toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _most(words: DataFrame, known: int) -> tuple[np.ndarray, bool]:
    """(keys of up to `known` words, the most frequent ones, whether these are all)."""
    steps = words.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("n").alias("least")).collect()  # some 500 rows
    reach, least = 0, 2**62
    for r in sorted(steps, key=lambda r: -r["step"]):
        reach += r["n"]
        if reach > known:
            break
        least = r["least"]
    return _column(words.where(F.col("n") >= least).select("key")), reach <= known  # `known` rows at most


def _side(df: DataFrame) -> DataFrame:
    """A stored side of a join: broadcast if it is small, else left to a shuffle, whose skew Spark splits."""
    return F.broadcast(df) if df.count() <= BROADCAST_PHRASES else df


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _scored(phrases: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """(words, a, l, r, score, k): each phrase at its cut of the lowest score, of equal ones the first."""
    cuts = [(F.slice("words", 1, k), F.slice("words", F.lit(k + 1), F.size("words") - k), F.lit(k)) for k in range(1, longest)]
    cut = F.array(*[F.when(F.size("words") > k, F.struct(head.alias("head"), tail.alias("tail"), n.alias("k"))) for k, (head, tail, n) in enumerate(cuts, 1)])
    rows = phrases.select("words", "a", F.explode(F.array_compact(cut)).alias("c")).select("words", "a", "c.*")
    part = _side(counts)
    rows = rows.join(part.select(F.col("words").alias("head"), F.col("f").alias("l")), "head").join(part.select(F.col("words").alias("tail"), F.col("f").alias("r")), "tail")
    rows = rows.withColumn("top", F.lit(2_000_000).cast("decimal(7,0)") * _exact("a")).withColumn("sum", _exact("l") + _exact("r"))
    best = rows.groupBy("words", "a").agg(F.min(F.struct(F.expr("top div sum").alias("score"), "k", "l", "r")).alias("b"))
    return best.select("words", "a", "b.l", "b.r", "b.score", "b.k")


def _not_inside(scored: DataFrame, phrases: DataFrame, cover: int, longest: int) -> DataFrame:
    """Rows but those that a longer phrase holds that comes nearly as often."""

    def runs(m: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - m + 1, F.lit(1))), lambda i: F.slice(F.col("words"), i, m))

    inner = [F.when(F.size("words") > m, runs(m)) for m in range(2, longest)]
    if not inner:
        return scored
    held = phrases.select("a", F.explode(F.flatten(F.array_compact(F.array(*inner)))).alias("_words")).groupBy("_words").agg(F.max("a").alias("_f"))
    nearly = _exact("_f") * 100 >= _exact("a") * cover
    return scored.join(held, scored["words"] == held["_words"], "left").where(~F.coalesce(nearly, F.lit(False))).drop("_words", "_f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER, known: int = KNOWN, safe: int = SAFE, trie: int = TRIE) -> DataFrame:
    """docs (lang, text) to (lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    A-Z count as a-z; `.,;:!?` and U+000A to U+000D part pieces, blanks and tabs words.  Null texts are empty; texts without a
    language are of `und`.  a, l, r are the frequencies of a phrase and of its two parts at the cut that scores
    floor(2,000,000 a / (l + r)), the lowest; n counts all words of the language.  A phrase goes that a longer one of `least`
    occurrences holds, with 100 times its frequency at `cover` times a or more.  Ordered by score, a (both falling) and phrase.
    Repeated rows count as often as they stand there.  known, safe and trie bound what is broadcast, not the result.
    """
    if least < 1 or longest < 2:
        raise ValueError("phrases occur, and have two words at least")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    counted = texts.mapInArrow(_count, "lang string, key long, word string, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted.where((F.col("n") >= least) | (F.col("key") == 0)))
    words, totals = counted.where("key <> 0"), counted.where("key = 0").select("lang", F.col("n").alias("all"))
    keys, complete = _most(words, known)
    table = spark.sparkContext.broadcast((np.sort(keys.view(np.uint64)), complete))
    streams = written(texts.mapInArrow(_streams(table), "codes binary"), "streams")
    pairs = _frequent_runs(streams, _pairs, least)
    fit = None
    if pairs.count() <= safe:
        ends = pairs.select(F.col("words")[0].alias("a"), F.col("words")[1].alias("b")).toArrow()  # `safe` rows at most
        fit = np.sort(_hashed(np.stack([ends.column(c).to_numpy() for c in "ab"], axis=1)))
    candidates = pairs.union(_frequent_runs(streams, _longer(fit, longest), least)) if longest > 2 else pairs
    phrases = stored(_frequencies(streams, candidates, trie).where(F.col("a") >= least))
    code = _code_of(words, keys, complete)
    counts = stored(phrases.select("words", F.col("a").alias("f")).union(code.select(F.array("code"), "n")))
    kept = stored(_not_inside(_scored(phrases, counts, longest), phrases, cover, longest))
    spelled = kept.select("words", F.posexplode("words").alias("i", "code")).join(_side(code.select("code", "lang", "word")), "code")
    spelled = spelled.groupBy("words").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = kept.join(spelled, "words").select("lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    first = named.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # a language's candidates are too many for a task
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= BROADCAST_PHRASES else totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), "score")


def _code_of(words: DataFrame, keys: np.ndarray, complete: bool) -> DataFrame:
    """words with code LONG: as the streams have it."""
    order = np.sort(keys.view(np.uint64)).view(np.int64)
    listed = words.sparkSession.createDataFrame(pa.table({"_key": pa.array(order), "_at": pa.array(np.arange(1, len(order) + 1))}))
    joined = words.join(listed, words["key"] == listed["_key"], "inner" if complete else "left")
    other = -1 - F.shiftrightunsigned("key", 1)
    return stored(joined.select("lang", "word", "n", F.coalesce("_at", other).alias("code")))
