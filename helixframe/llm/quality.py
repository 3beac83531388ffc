"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. Each text becomes a fixed vector of statistics: shares of character classes, word lengths, repetition of words and lines.
2. Standardised statistics x become z = sqrt(2 / D) cos(W x + b) with Gaussian W, so that z(x) . z(y) approximates a Gaussian
   kernel.
3. Ridge weights solve the normal equations, whose entries are sums over partitions.  z is held in fixed point, so the sums
   are of whole numbers and don't depend on the order in which partitions arrive.
4. Labelled rows that took no part in the fit are binned by raw score; pool-adjacent-violators over the bins makes scores
   probabilities.

The driver sees means, one matrix of (D + 1)^2 / 2 sums and BINS pairs of counts, whatever the size of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .recovery import stored
from .text import SMALL, give_back, hash_spans, utf8, word_bounds

#: Scores from which on a text is kept.
THRESHOLD = 0.3
BINS, LOW, HIGH = 1024, -0.5, 1.5
FIXED = 1 << 16  # z in 1/65536: products below 2^33, so sums of 2^30 rows stay whole
#: Bytes of text whose statistics are computed at once; they take some 60 times as much memory.
BLOCK = SMALL

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n\r",
    "stop": b".?", "comma": b",;:", "shout": b"!", "bar": b"|", "symbol": b"#$%&*@=~^<>{}[]\\/_+", "quote": b"\"'`()-",
}
_CLASS = np.full(256, len(_CLASSES), np.int64)
_CLASS[128:] += 1
for _i, _chars in enumerate(_CLASSES.values()):
    _CLASS[list(_chars)] = _i
_N = len(_CLASSES) + 2
STATISTICS = _N + 7


def _repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the share of its items that occur earlier in it."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[again], minlength=len(first) - 1) / np.maximum(np.diff(first), 1)


def _block(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    share = np.bincount(owner * _N + _CLASS[data], minlength=n * _N).reshape(n, _N) / np.maximum(size, 1)[:, None]
    starts, ends, first = word_bounds(data, offsets)
    words, lengths = np.diff(first), ends - starts
    of = np.repeat(np.arange(n), words)
    mean = np.bincount(of, lengths, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(of, lengths.astype(float) ** 2, n) / np.maximum(words, 1) - mean**2, 0))
    short = np.bincount(of, lengths <= 3, n) / np.maximum(words, 1)
    hashes = hash_spans(data, starts, ends)
    line_ends = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate([offsets[:-1][size > 0], line_ends + 1]))
    cut = cut[cut < len(data)]
    word_sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])  # whole numbers, or sums would depend on the batch
    at = np.searchsorted(starts, np.append(cut, len(data)))
    lines = word_sum[at[1:]] - word_sum[at[:-1]]
    line_first = np.searchsorted(cut, offsets)
    extra = [np.log1p(size), mean, spread, short, _repeated(hashes, first), _repeated(lines, line_first), np.log1p(np.diff(line_first) / np.maximum(words, 1))]
    return np.column_stack([np.sqrt(share), *extra])


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text; null counts as empty."""
    data_size = max(1, column.nbytes)
    step = max(1, len(column) * BLOCK // data_size)
    parts = [_block(column.slice(i, step)) for i in range(0, len(column), step)]
    give_back()  # a function of columns is not told where its partition ends
    return np.concatenate(parts) if parts else np.zeros((0, STATISTICS))


@F.arrow_udf(ArrayType(DoubleType()))
def statistics_of(text: pa.Array) -> pa.Array:
    x = statistics(text)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS), pa.array(x.ravel()))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray  # the last one is the intercept's
    calibrated: np.ndarray  # by bin of the raw score

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.column_stack([np.rint(z * FIXED), np.full(len(x), FIXED)]).astype(np.int64)

    def bins(self, x: np.ndarray) -> np.ndarray:
        raw = self.fourier(x) @ self.weights / FIXED
        return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated[self.bins(x)]


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Nondecreasing least-squares fit of positive / total over bins; empty bins lie on the line between their neighbours."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total):
        blocks.append([positive[i], total[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, t, _, last = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += t
            blocks[-1][3] = last
    if not blocks:
        return np.full(len(total), 0.5)
    at = [x for b in blocks for x in b[2:]]
    return np.interp(np.arange(len(total)), at, [(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in "ab"])


def fit(rows: DataFrame, features: int = 128, ridge: float = 1e-3, width: float = 4.0, seed: int = 7) -> Model:
    """Fit on rows (statistics ARRAY<DOUBLE>, label INT, calibrate BOOLEAN).

    All labelled rows take part: those with calibrate false in the ridge regression, the others in the calibration.  Rows
    whose label is null take no part.  Without any row, every score is 0.5.
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / width, (STATISTICS, features))
    b = rng.uniform(0, 2 * np.pi, features)
    rows = rows.where("label is not null and statistics is not null")
    train = rows.where("not calibrate")
    # sums of whole numbers again: millionths of the statistics and of their squares
    whole = lambda x: F.sum((x * 1e6).cast("decimal(20,0)"))
    columns = [F.col("statistics")[i] for i in range(STATISTICS)]
    got = train.agg(F.count("*"), *map(whole, columns), *[whole(c * c) for c in columns]).first()
    n = got[0]
    values = np.array([float(v or 0) for v in got[1:]]) / 1e6 / max(n, 1)
    mean = values[:STATISTICS]
    scale = np.sqrt(np.maximum(values[STATISTICS:] - mean**2, 1e-6))
    model = Model(mean, scale, w, b, np.zeros(features + 1), np.full(BINS, 0.5))
    if not n:
        return model

    def partial(batches):
        total = np.zeros((features + 1, features + 2), np.int64)
        for batch in batches:
            x = np.array(batch.column("statistics").values).reshape(-1, STATISTICS) if batch.num_rows else np.zeros((0, STATISTICS))
            z = model.fourier(x)
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            f = z.astype(float)  # exact: whole numbers below 2^53
            total[:, :-1] += np.rint(f.T @ f).astype(np.int64)
            total[:, -1] += z.T @ y
        i, j = np.nonzero(np.triu(np.ones_like(total)))
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    cells = train.select("statistics", F.col("label").cast("int").alias("label")).mapInArrow(partial, "i int, j int, v long")
    a = np.zeros((features + 1, features + 2))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():  # as many rows as the matrix has entries
        a[r.i, r.j] = r.v
    gram = np.triu(a[:, :-1]) + np.triu(a[:, :-1], 1).T
    weights = np.linalg.solve(gram / FIXED**2 + np.eye(features + 1) * ridge * n / features, a[:, -1] / FIXED)
    model = Model(mean, scale, w, b, weights, model.calibrated)

    @F.arrow_udf("int")
    def bin_of(x: pa.Array) -> pa.Array:
        return pa.array(model.bins(np.array(x.flatten()).reshape(-1, STATISTICS)).astype(np.int32))

    total, positive = np.zeros(BINS), np.zeros(BINS)
    held = rows.where("calibrate").select(bin_of("statistics").alias("bin"), "label")
    for r in held.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect():  # BINS rows at most
        total[r.bin], positive[r.bin] = r.n, r.p
    return Model(mean, scale, w, b, weights, isotonic(total, positive))


def score(model: Model, text: Column) -> Column:
    """The calibrated score of a text column, 0 to 1; null and empty texts get the score of an empty text."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(statistics(texts)))

    return scored(text)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit `quality` of labels on the texts of docs, without the fold crc32(doc_id) % 5 = 0; fold 4 calibrates."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).where("label is not null")
    stats = docs.select(F.col("doc_id"), fold(F.col("doc_id"), 5).alias("fold"), statistics_of("text").alias("statistics")).where("fold <> 0")
    rows = stats.join(marks, stats.doc_id == marks._id).select("statistics", "label", (F.col("fold") == 4).alias("calibrate"))
    return fit(stored(rows))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score DOUBLE, predicted INT and held_out BOOLEAN added (columns of docs of those names are replaced)."""
    model = fit_documents(docs, labels)
    return docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 0).withColumn("score", score(model, F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
