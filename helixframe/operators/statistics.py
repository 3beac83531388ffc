"""Statistics of sequences: nucleotide counts, sliding GC content, homopolymer regions, and rollups of coding metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flat, metrics

NUCLEOTIDES = "ATCG"


def count_of(seq: Column, letter: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))).cast("long")


def nucleotide_counts(df: DataFrame, *by: str, seq: str = "dna") -> DataFrame:
    """(by..., base, n): A, T, C and G, 0 where absent; other characters and lower case don't count."""
    sums = df.groupBy(*by).agg(*[F.coalesce(F.sum(count_of(F.col(seq), b)), F.lit(0)).alias(b) for b in NUCLEOTIDES])
    return sums.select(*by, F.expr("stack(4, " + ", ".join(f"'{b}', {b}" for b in NUCLEOTIDES) + ") as (base, n)"))


def sliding_gc(df: DataFrame, id_col: str, seq: str = "dna", window: int = 50, step: int = 10) -> DataFrame:
    """(id, window_start, gc) of all full windows: G and C among A, T, C and G in it, in either case, 0 without any.

    Counts of a window are differences of running sums, taken for all sequences of a batch at once: no shuffle.
    """
    if window <= 0 or step <= 0:
        raise ValueError("window and step must be positive")
    kind = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = flat.large(batch.column("seq"))
            for first, past in flat.pieces(column):
                codes, offsets = flat.letters(column.slice(first, past - first))
                gc, nt = (np.concatenate([[0], np.cumsum(np.isin(codes, np.frombuffer(letters, np.uint8)))]) for letters in (b"GC", b"ATCG"))
                n = np.maximum((np.diff(offsets) - window) // step + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
                at = offsets[row] + start
                known = nt[at + window] - nt[at]
                share = np.where(known == 0, 0.0, (gc[at + window] - gc[at]) / np.maximum(known, 1))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row + first)), pa.array(start.astype(np.int32)), pa.array(share)], [id_col, "window_start", "gc"])

    return df.select(id_col, F.upper(seq).alias("seq")).mapInArrow(rows, f"{id_col} {kind}, window_start int, gc double")


def homopolymer_regions(df: DataFrame, id_col: str, seq: str = "dna", min_len: int = 4) -> DataFrame:
    """(id, start_pos, end_pos, base): runs of one character, upper-cased, of at least min_len; ends are included."""
    if min_len < 2:
        raise ValueError("the shortest region has two characters")
    kind = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = flat.large(batch.column("seq"))
            for first, past in flat.pieces(column):
                codes, offsets = flat.letters(column.slice(first, past - first))
                begins = np.zeros(len(codes) + 1, bool)
                begins[1:-1] = codes[1:] != codes[:-1]
                begins[offsets] = True  # runs end with their sequence
                edges = np.flatnonzero(begins)
                long = np.flatnonzero(np.diff(edges) >= min_len)
                start, length = edges[long], np.diff(edges)[long]
                row = np.searchsorted(offsets, start, "right") - 1
                places = [pa.array((p - offsets[row]).astype(np.int32)) for p in (start, start + length - 1)]
                bases = flat.texts(codes[start], np.arange(len(start) + 1)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row + first)), *places, bases], [id_col, "start_pos", "end_pos", "base"])

    return df.select(id_col, F.upper(seq).alias("seq")).mapInArrow(rows, f"{id_col} {kind}, start_pos int, end_pos int, base string")


def homopolymer_regions_by_window(df: DataFrame, id_col: str, seq: str = "dna", min_len: int = 4) -> DataFrame:
    """The same rows by a window over all runs, in built-in functions; for checks on small tables."""
    runs = df.select(id_col, F.posexplode(F.regexp_extract_all(F.upper(seq), F.lit(r"(?s)((.)\2*)"), F.lit(1))).alias("run", "piece"))
    end = F.sum(F.length("piece")).over(Window.partitionBy(id_col).orderBy("run")) - 1
    placed = runs.select(id_col, (end - F.length("piece") + 1).cast("int").alias("start_pos"), end.cast("int").alias("end_pos"), F.substr("piece", F.lit(1), F.lit(1)).alias("base"), F.length("piece").alias("n"))
    return placed.where(F.col("n") >= min_len).drop("n")


def metrics_rollup(df: DataFrame, *by: str) -> DataFrame:
    """Sums of n_bytes and n_nt over each level of `by`, and the metrics of the sums."""
    sums = df.rollup(*by).agg(F.count("*").alias("n_payloads"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_nt").alias("n_nt"))
    return sums.withColumn("bits_per_nt", metrics.bits_per_nt(F.col("n_bytes"), F.col("n_nt"))).withColumn("ratio", metrics.compression_ratio(F.col("n_bytes"), F.col("n_nt")))


def correction_report(df: DataFrame, *by: str) -> DataFrame:
    """Sums of corrected, uncorrectable and the number of bad_blocks for each method and code."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum("corrected").alias("corrected"), F.sum("uncorrectable").alias("uncorrectable"), F.sum(F.size("bad_blocks")).alias("bad_blocks"))
