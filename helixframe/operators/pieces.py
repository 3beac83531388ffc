"""Operators on sequences that come in pieces, (id, piece, text), so that one sequence is worked on by many tasks.

Pieces are in order of the column piece, any numbers; what belongs together at their borders travels, not the pieces' texts: runs
at the ends, or the first characters of the pieces that follow.

Block codes work on aligned pieces: a block belongs to the piece where it starts.  What their functions return is again in pieces,
in order of `at`; put together by it they are the whole's result, and their counts add up to the whole's.  Values without
characters or bytes have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flat, hamming, parity, repeat
from ..sources.folders import shared


def cut(df: DataFrame, id_col: str, seq: str, size: int) -> DataFrame:
    """(id, piece INT, seq): each sequence in pieces of `size` characters, at least one; null sequences have none."""
    kind = df.schema[seq].dataType.simpleString()
    key = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.sliced(batch, "_seq"):
                column = flat.large(part.column("_seq"))
                codes, offsets = flat.letters(column) if kind == "string" else flat.values(column)
                n = np.maximum(-(-np.diff(offsets) // size), 1)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                ends = np.append(offsets[row] + piece * size, offsets[-1])
                cuts = flat.texts(codes, ends) if kind == "string" else flat.column(codes, ends, pa.large_binary())
                yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), cuts.cast(batch.schema.field("_seq").type)], [id_col, "piece", seq])

    there = df.where(F.col(seq).isNotNull()).select(F.col(id_col).alias("_id"), F.col(seq).alias("_seq"))
    return there.mapInArrow(rows, f"{id_col} {key}, piece int, {seq} {kind}")


def _starts(sizes: DataFrame, id_col: str, piece: str) -> DataFrame:
    """The rows of pieces (id, piece, length, ...) with `at`, their number from 0 without gaps, and `start`, the lengths before."""
    order = Window.partitionBy(id_col).orderBy(piece)
    start = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("at", F.row_number().over(order) - 1).withColumn("start", start)


def placed(df: DataFrame, id_col: str, piece: str, seq: str) -> DataFrame:
    """(id, piece, at, start, length): the pieces with characters, numbered from 0 without gaps, and how many stand before each.

    Lengths alone are shuffled.
    """
    sizes = df.select(id_col, piece, F.length(seq).cast("long").alias("length")).where("length > 0")
    return _starts(sizes, id_col, piece).select(id_col, piece, "at", "start", "length")


def _haloed(df: DataFrame, id_col: str, piece: str, seq: str, size: int, given: DataFrame | None = None) -> DataFrame:
    """`with_halo`, with total, the sequence's length, and the columns that `given` has beside _id, an id once.

    A first pass over the pieces writes their lengths and heads; all that pieces need to know is put together from these, so that
    the pieces themselves are made and shuffled once more only.
    """
    spark, there = df.sparkSession, df.where(F.length(seq) > 0).select(id_col, piece, seq)
    binary = df.schema[seq].dataType.simpleString() == "binary"
    head = F.substr(seq, F.lit(1), F.lit(size))
    heads = there.select(id_col, piece, F.length(seq).cast("long").alias("length"), (F.hex(head) if binary else head).alias("head"))
    path = shared(spark, "heads")
    heads.write.parquet(path)
    where = _starts(spark.read.schema(heads.schema).parquet(path), id_col, piece)
    totals = where.groupBy(F.col(id_col).alias("_total_id")).agg(F.sum("length").alias("total"))
    # the first piece that ends within `size` before this one's start is found among those before it, by their ends
    ends = Window.partitionBy(id_col).orderBy("end").rangeBetween(-max(size - 1, 0), Window.currentRow)
    first = where.withColumn("end", F.col("start") + F.col("length")).withColumn("reach", F.min("at").over(ends))
    first = first.withColumn("reach", F.lag("reach").over(Window.partitionBy(id_col).orderBy("at"))).drop("end")
    sent = first.where("reach is not null").where(F.lit(size > 0)).select(F.col(id_col).alias("_to_id"), F.col("at").alias("_from"), F.explode(F.sequence("reach", F.col("at") - 1)).alias("_to"), F.col("head").alias("_head"))
    ordered = F.array_sort(F.collect_list(F.struct("_from", "_head")))
    tail = F.substr(F.array_join(F.transform(ordered, lambda h: h["_head"]), ""), F.lit(1), F.lit(size * 2 if binary else size))
    tails = sent.groupBy("_to_id", "_to").agg(tail.alias("tail"))
    about = where.drop("head").join(tails, F.col(id_col).eqNullSafe(F.col("_to_id")) & (F.col("at") == F.col("_to")), "left").drop("_to_id", "_to")
    about = about.join(totals, F.col(id_col).eqNullSafe(F.col("_total_id"))).drop("_total_id")
    if given is not None:
        about = about.join(given, F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")
    about = about.withColumnsRenamed({id_col: "_id", piece: "_piece"})
    tail = F.coalesce("tail", F.lit(""))
    about = about.withColumn("tail", F.unhex(tail) if binary else tail)
    return there.join(about, F.col(id_col).eqNullSafe(F.col("_id")) & F.col(piece).eqNullSafe(F.col("_piece"))).drop("_id", "_piece")


def with_halo(df: DataFrame, id_col: str, piece: str, seq: str, size: int) -> DataFrame:
    """(id, piece, at, start, length, seq, tail): each piece with the `size` characters that follow it, or as many as there are.

    Every piece sends its first characters to those that end less than `size` before it begins: one where pieces are longer
    than that, several where they are shorter.
    """
    return _haloed(df, id_col, piece, seq, size).select(id_col, piece, "at", "start", "length", seq, "tail")


def sliding_gc(df: DataFrame, id_col: str, piece: str = "piece", seq: str = "dna", window: int = 50, step: int = 10) -> DataFrame:
    """(id, window_start LONG, gc) of all full windows of the whole sequence, as `statistics.sliding_gc` has them.

    A window belongs to the piece where it starts; what it needs of later pieces comes with the piece's halo.
    """
    if window <= 0 or step <= 0:
        raise ValueError("window and step must be positive")
    upper = df.select(id_col, piece, F.upper(seq).alias("seq"))
    kind = upper.schema[id_col].dataType.simpleString()
    haloed = with_halo(upper, id_col, piece, "seq", window - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = flat.large(batch.column("text"))
            begins, lengths = (batch.column(c).to_numpy() for c in ("start", "length"))
            for first, past in flat.pieces(column):
                codes, offsets = flat.letters(column.slice(first, past - first))
                gc, nt = (np.concatenate([[0], np.cumsum(np.isin(codes, np.frombuffer(letters, np.uint8)))]) for letters in (b"GC", b"ATCG"))
                skip = -begins[first:past] % step  # to the first window that starts here
                room = np.minimum(lengths[first:past] - 1, np.diff(offsets) - window)  # the last place where one can
                n = np.maximum((room - skip) // step + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                start = skip[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
                at = offsets[row] + start
                known = nt[at + window] - nt[at]
                share = np.where(known == 0, 0.0, (gc[at + window] - gc[at]) / np.maximum(known, 1))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row + first)), pa.array(begins[first:past][row] + start), pa.array(share)], [id_col, "window_start", "gc"])

    return haloed.select(id_col, "start", "length", F.concat("seq", "tail").alias("text")).mapInArrow(rows, f"{id_col} {kind}, window_start long, gc double")


def homopolymer_regions(df: DataFrame, id_col: str, piece: str = "piece", seq: str = "dna", min_len: int = 4) -> DataFrame:
    """(id, start_pos LONG, end_pos LONG, base) of the whole sequence, as `statistics.homopolymer_regions` has them.

    A piece keeps the regions inside it and tells of its first and its last run; of these, neighbours of one base are joined,
    over any number of pieces.
    """
    if min_len < 2:
        raise ValueError("the shortest region has two characters")
    upper = df.select(id_col, piece, F.upper(seq).alias("seq"))
    kind, order = (upper.schema[c].dataType.simpleString() for c in (id_col, piece))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = flat.large(batch.column("seq"))
            for first, past in flat.pieces(column):
                codes, offsets = flat.letters(column.slice(first, past - first))
                begins = np.zeros(len(codes) + 1, bool)
                begins[1:-1] = codes[1:] != codes[:-1]
                begins[offsets] = True
                edges = np.flatnonzero(begins)
                start, length = edges[:-1], np.diff(edges)
                row = np.searchsorted(offsets, start, "right") - 1
                border = np.isin(start, offsets[:-1]) | np.isin(start + length, offsets[1:])
                keep = np.flatnonzero(border | (length >= min_len))
                row, start, length, border = row[keep], start[keep], length[keep], border[keep]
                bases = flat.texts(codes[start], np.arange(len(start) + 1)).cast(pa.string())
                of = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(of), batch.column(piece).take(of), pa.array(start - offsets[row]), pa.array(length), bases, pa.array(border)], [id_col, piece, "place", "n", "base", "border"])

    path = shared(df.sparkSession, "runs")  # what is left of the pieces, which are read once
    runs = upper.where("seq is not null").mapInArrow(rows, f"{id_col} {kind}, {piece} {order}, place long, n long, base string, border boolean")
    runs.write.parquet(path)
    runs = df.sparkSession.read.schema(runs.schema).parquet(path)
    sizes = runs.where("border").groupBy(id_col, piece).agg(F.max(F.col("place") + F.col("n")).alias("length"))  # the last run of a piece ends it
    line = Window.partitionBy(id_col).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    where = sizes.select(F.col(id_col).alias("_id"), F.col(piece).alias("_piece"), F.coalesce(F.sum("length").over(line), F.lit(0)).alias("start"))
    runs = runs.join(where, F.col(id_col).eqNullSafe(F.col("_id")) & F.col(piece).eqNullSafe(F.col("_piece"))).withColumn("begin", F.col("start") + F.col("place"))
    inside = runs.where(~F.col("border")).select(id_col, "begin", "n", "base")
    line = Window.partitionBy(id_col).orderBy("begin")
    same = (F.lag("base").over(line) == F.col("base")) & (F.lag(F.col("begin") + F.col("n")).over(line) == F.col("begin"))
    ends = runs.where("border").withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int"))
    joined = ends.withColumn("run", F.sum("new").over(line)).groupBy(id_col, "run").agg(F.min("begin").alias("begin"), F.sum("n").alias("n"), F.first("base").alias("base"))
    every = inside.union(joined.select(id_col, "begin", "n", "base")).where(F.col("n") >= min_len)
    return every.select(id_col, F.col("begin").alias("start_pos"), (F.col("begin") + F.col("n") - 1).alias("end_pos"), "base")


def aligned(df: DataFrame, id_col: str, piece: str, seq: str, unit: int, given: DataFrame | None = None) -> DataFrame:
    """(id, piece, at, start, total, seq): the blocks of `unit` characters that start in each piece, `start` a multiple of it.

    Only the last block of a sequence may be short; total is the sequence's length.  A piece where no block starts has no row.
    `given` has _id, an id once, and columns that the rows get, null for other ids.
    """
    haloed = _haloed(df, id_col, piece, seq, unit - 1, given)
    skip = (-F.col("start")) % unit
    skip = F.when(skip < 0, skip + unit).otherwise(skip)
    blocks = F.ceil((F.col("length") - skip) / F.lit(unit))
    own = F.substr(F.concat(seq, "tail"), (skip + 1).cast("int"), (blocks * unit).cast("int"))
    more = [c for c in given.columns if c != "_id"] if given is not None else []
    return haloed.where(F.col("length") > skip).select(id_col, piece, "at", (F.col("start") + skip).alias("start"), "total", own.alias(seq), *more)


def hamming_encode(df: DataFrame, id_col: str, piece: str = "piece", content: str = "content") -> DataFrame:
    """(id, piece, at, encoded BINARY, padding INT) of payloads in pieces: four bytes are 56 bits, so only the last piece is padded."""
    parts = aligned(df.select(id_col, piece, content), id_col, piece, content, 4)
    return parts.select(id_col, piece, "at", hamming.encode(F.col(content)).alias("h")).select(id_col, piece, "at", "h.*")


def hamming_decode(df: DataFrame, paddings: DataFrame, id_col: str, piece: str = "piece", encoded: str = "encoded", padding: str = "padding") -> DataFrame:
    """(id, piece, at, content BINARY, corrected INT, error) of encoded payloads in pieces; paddings has (id, padding), an id once.

    All pieces of a payload that can't be decoded, or that has no padding, carry its error.
    """
    given = paddings.select(F.col(id_col).alias("_id"), F.col(padding).alias("_padding"))
    parts = aligned(df.select(id_col, piece, F.col(encoded).alias("_code")), id_col, piece, "_code", 7, given)
    wrong = F.when(F.col("_padding").isNull(), "no padding is given").otherwise(hamming.length_error(F.col("total"), F.col("_padding")))
    last = F.col("start") + F.length("_code") == F.col("total")
    parts = parts.withColumn("error", wrong)
    decoded = hamming.decode(F.when(F.col("error").isNull(), F.col("_code")), F.when(last, F.col("_padding")).otherwise(0))
    return parts.select(id_col, piece, "at", decoded.alias("d"), "error").select(id_col, piece, "at", "d.content", "d.corrected", "error")


def parity_add(df: DataFrame, id_col: str, piece: str = "piece", seq: str = "dna", k: int = parity.BLOCK) -> DataFrame:
    """(id, piece, at, seq) of sequences in pieces, with parity nucleotides."""
    parts = aligned(df.select(id_col, piece, seq), id_col, piece, seq, k)
    return parts.select(id_col, piece, "at", parity.add(F.col(seq), k).alias(seq))


def parity_strip(df: DataFrame, id_col: str, piece: str = "piece", seq: str = "dna", k: int = parity.BLOCK) -> DataFrame:
    """(id, piece, at, seq, bad_blocks ARRAY<LONG>) of sequences in pieces; blocks are numbered over the whole sequence."""
    parts = aligned(df.select(id_col, piece, seq), id_col, piece, seq, k + 1)
    first = F.floor(F.col("start") / F.lit(k + 1))
    bad = F.transform("s.bad_blocks", lambda b: b + first)
    return parts.select(id_col, piece, "at", "start", parity.strip(F.col(seq), k).alias("s")).select(id_col, piece, "at", F.col("s.sequence").alias(seq), bad.alias("bad_blocks"))


def repeat_decode(df: DataFrame, id_col: str, piece: str = "piece", seq: str = "dna") -> DataFrame:
    """(id, piece, at, seq, corrected, uncorrectable, error) of triple-repeat sequences in pieces; of a bad length all pieces tell."""
    parts = aligned(df.select(id_col, piece, seq), id_col, piece, seq, 3)
    parts = parts.withColumn("error", F.when(F.col("total") % 3 != 0, "length is not a multiple of 3"))
    voted = repeat.decode(F.when(F.col("error").isNull(), F.col(seq)))
    return parts.select(id_col, piece, "at", voted.alias("v"), "error").select(id_col, piece, "at", F.col("v.sequence").alias(seq), "v.corrected", "v.uncorrectable", "error")
