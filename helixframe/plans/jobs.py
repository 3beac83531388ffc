"""Encoding and decoding of whole tables, and audits of the round trip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import base4, flat, hamming, header, metrics, parity, repeat, screen
from ..operators import balanced, huffman
from ..sources import fasta, named, payloads
from ..sources.folders import shared

#: Bytes of contents, or characters of sequences, that a task codes at once.
PART = 1 << 20
METHODS, CODES = ("base4_direct", "huffman", "gc_balanced"), (None, "hamming_7_4", "triple_repeat")


def encode_table(df: DataFrame, method: str = "base4_direct", fec: str | None = None, add_parity: bool = False, k: int = parity.BLOCK, name: str = "name", gc_min: float = screen.GC_MIN, gc_max: float = screen.GC_MAX, max_run: int = screen.MAX_RUN) -> DataFrame:
    """(id, name, content, ...) to (id, header, sequence, n_bytes, n_nt, ratio, bits_per_nt) and the other columns.

    hamming_7_4 codes the bytes first, and then no parity is added; triple_repeat codes the sequence last.  gc_balanced takes
    no parity either.  huffman gives each row a code book of its own.  Narrow throughout; a null content gives a null sequence.
    """
    if method not in METHODS or fec not in CODES:
        raise ValueError(f"unknown method or code: {method}, {fec}")
    with_parity = add_parity and fec != "hamming_7_4" and method != "gc_balanced"
    if with_parity and k <= 0:
        raise ValueError("the block length must be positive")
    plain = df.withColumn("n_bytes", F.length("content").cast("long"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.sliced(batch, "content", PART):
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["content"]).columns, *coded(part.column("content"), method, fec, add_parity, k, gc_min, gc_max, max_run)], names)

    kept = plain.drop("content").schema
    names = [*kept.names, "sequence", "_bits", "_table", "_padding"]
    shape = T.StructType([*kept.fields]).add("sequence", T.StringType()).add("_bits", T.IntegerType()).add("_table", T.MapType(T.StringType(), T.StringType())).add("_padding", T.IntegerType())
    out = plain.mapInArrow(rows, shape)
    fields: dict = {}
    if fec == "hamming_7_4":
        fields["fec_padding_bits"] = F.col("_bits")
    if method == "huffman":
        fields["huffman_params"] = F.struct(F.col("_table").alias("table"), F.col("_padding").alias("padding"))
    elif method == "gc_balanced":
        fields |= {"gc_min": F.lit(gc_min), "gc_max": F.lit(gc_max), "max_homopolymer": F.lit(max_run)}
    if with_parity:
        fields |= {"parity_k": F.lit(k), "parity_rule": F.lit(parity.RULE)}
    head = header.build(F.lit(method), F.col(name), F.lit(fec).cast("string"), **fields)
    out = out.withColumn("header", head).withColumn("n_nt", F.length("sequence").cast("long"))
    out = out.withColumn("ratio", metrics.compression_ratio(F.col("n_bytes"), F.col("n_nt"))).withColumn("bits_per_nt", metrics.bits_per_nt(F.col("n_bytes"), F.col("n_nt")))
    own = ["header", "sequence", "n_nt", "ratio", "bits_per_nt"]
    return out.select(*kept.names, *own)


def coded(payload: pa.Array, method: str, fec: str | None, add_parity: bool, k: int = parity.BLOCK, gc_min: float = screen.GC_MIN, gc_max: float = screen.GC_MAX, max_run: int = screen.MAX_RUN) -> list[pa.Array]:
    """[sequence, padding bits of the Hamming code, Huffman table, its padding] of a batch of payloads."""
    bits = pa.nulls(len(payload), pa.int32())
    if fec == "hamming_7_4":
        bits = pa.array([None if n is None else -n * 14 % 8 for n in pc.binary_length(payload).to_pylist()], pa.int32())
        payload = hamming.protected(payload)
    table, padding = pa.nulls(len(payload), huffman.TABLE), pa.nulls(len(payload), pa.int32())
    if method == "huffman":
        own = huffman.encoded_alone(payload)
        dna, table, padding = (own.field(n) for n in ("dna", "table", "padding"))
    elif method == "gc_balanced":
        own = balanced.coded(payload, gc_min, gc_max, max_run)
        dna = pc.binary_join_element_wise(own.field("signal"), own.field("dna"), "")
    else:
        dna = base4.coded(payload)
    if add_parity and fec != "hamming_7_4" and method != "gc_balanced":
        dna = parity.added(dna, k)
    return [repeat.tripled(dna) if fec == "triple_repeat" else dna, bits, table, padding]


def decode_table(df: DataFrame, k: int | None = None, warnings: bool = False) -> DataFrame:
    """(id, header, sequence) to (id, method, fec, content, corrected, uncorrectable, bad_blocks, error).

    Each row is decoded as its own header says; k overrides the header's block length.  Rows that can't be decoded have an
    error and no content, and the others go on; an unknown parity rule, or one without a positive block length, is an error.  A
    triple-repeat sequence of wrong length is decoded as it is, and bytes that Hamming decoding refuses are returned undecoded;
    with `warnings` a column warning, null for other rows, says which of the two happened.
    """
    h = header.parse(F.col("header"))
    size = F.lit(k) if k else h["parity_k"]
    named = {"id": F.col("id"), "method": h["method"], "fec": h["fec"], "bits": h["fec_padding_bits"], "k": size, "rule": h["parity_rule"], "table": h["huffman_params"]["table"], "padding": h["huffman_params"]["padding"], "dna": F.col("sequence")}
    fields = df.select(*[c.alias(n) for n, c in named.items()])
    kind = fields.schema["id"].dataType.simpleString()
    out = fields.mapInArrow(_undone, f"id {kind}, method string, fec string, content binary, corrected int, uncorrectable int, bad_blocks array<int>, error string, warning string")
    return out if warnings else out.drop("warning")


def _undone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, method, fec, bits, k, rule, table, padding, dna), decoded in parts of PART characters."""
    names = ["id", "method", "fec", "content", "corrected", "uncorrectable", "bad_blocks", "error", "warning"]
    for batch in batches:
        for part in flat.sliced(batch, "dna", PART):
            yield pa.RecordBatch.from_arrays(_decoded(part), names)


def _decoded(rows: pa.RecordBatch) -> list[pa.Array]:
    method, fec, dna, rule = (rows.column(n) for n in ("method", "fec", "dna", "rule"))
    flags = lambda c: pc.fill_null(c, False)
    text, none = pa.scalar(None, pa.string()), pa.scalar(None, pa.binary())
    tripled = flags(pc.equal(fec, "triple_repeat"))
    triple = pa.array(tripled.to_numpy(zero_copy_only=False) & (pc.fill_null(pc.utf8_length(dna), 1).to_numpy(zero_copy_only=False) % 3 == 0))
    voted, lost = pa.nulls(len(dna), pa.int32()), pa.nulls(len(dna), pa.int32())
    unvoted = pc.and_(pc.and_(tripled, pc.invert(triple)), dna.is_valid())
    if pc.any(triple).as_py():
        votes = repeat.voted(pc.if_else(triple, dna, text))
        dna = pc.if_else(triple, votes.field("sequence"), dna)
        voted, lost = (pc.if_else(triple, votes.field(n), pa.scalar(None, pa.int32())) for n in ("corrected", "uncorrectable"))
    ruled = flags(pc.equal(rule, parity.RULE))
    bad_blocks = pa.array([[]] * len(dna), pa.list_(pa.int32()))
    if pc.any(ruled).as_py():
        checked = parity.stripped(pc.if_else(ruled, dna, text), rows.column("k"))
        dna = pc.coalesce(checked.field("sequence"), dna)
        bad_blocks = pc.coalesce(checked.field("bad_blocks"), bad_blocks)
    unruled = pc.and_(rule.is_valid(), pc.invert(ruled))
    unsized = pc.and_(ruled, pc.invert(flags(pc.greater(rows.column("k"), 0))))
    error = pc.binary_join_element_wise("unknown method ", pc.coalesce(method, "(none)"), "")
    content = pa.nulls(len(dna), pa.binary())
    for one in METHODS:
        those = flags(pc.equal(method, one))
        if not pc.any(those).as_py():
            continue
        some = pc.if_else(those, dna, text)
        if one == "huffman":
            walked = huffman.decoded(some, rows.column("table"), rows.column("padding"))
            found, why = walked.field("content"), walked.field("error")
        else:
            found, why = (base4 if one == "base4_direct" else balanced).decoded(some)
        content, error = pc.if_else(those, found, content), pc.if_else(those, why, error)
    error = pc.if_else(unsized, "the parity block length is not positive", error)
    error = pc.if_else(unruled, pc.binary_join_element_wise("unknown parity rule ", rule, ""), error)
    content = pc.if_else(pc.or_(unruled, unsized), none, content)
    guarded = pc.and_(flags(pc.equal(fec, "hamming_7_4")), content.is_valid())
    flips, refused = pa.nulls(len(dna), pa.int32()), pa.array([False] * len(dna))
    if pc.any(guarded).as_py():
        bits = pc.fill_null(rows.column("bits"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64) * 8 - bits
        fit = pc.and_(guarded, pa.array((bits >= 0) & (bits <= 7) & (n >= 0) & (n % 7 == 0)))
        fixed = hamming.corrected(pc.if_else(fit, content, none), pa.array(bits))
        content, flips = pc.if_else(fit, fixed.field("content"), content), fixed.field("corrected")
        refused = pc.and_(guarded, pc.invert(fit))
    warning = pc.if_else(refused, "Hamming code not undone: bits are not those of whole codewords", pc.if_else(unvoted, "triple repeat not undone: length is not a multiple of 3", text))
    return [rows.column("id"), method, fec, content, pc.fill_null(pc.coalesce(voted, flips), 0), pc.fill_null(lost, 0), bad_blocks, error, warning]


def encode_files(spark: SparkSession, paths: str | list[str], folder: str, names: str = "*", **options) -> DataFrame:
    """Payload files to FASTA files, one for each, named as the payload with .fasta: (name, n_bytes, n_nt, bits_per_nt, error).

    options are those of `encode_table`, `names` a pattern of file names, as in `payloads.read_files`.  Rows of equal names have
    an error and no file; the others go on.
    """
    files = payloads.read_files(spark, paths, names).select(F.col("path").alias("id"), metrics.base_name(F.col("path")).alias("name"), "content")
    rows = encode_table(files, **options).select(metrics.encoded_name(F.col("name")).alias("name"), "n_bytes", "n_nt", "bits_per_nt", F.encode(fasta.to_text(F.col("header"), F.col("sequence"), fasta.JOB_WIDTH), "UTF-8").alias("content"))
    return _filed(spark, rows, folder, "n_bytes", "n_nt", "bits_per_nt")


def decode_files(spark: SparkSession, paths: str | list[str], folder: str, k: int | None = None, names: str = "*") -> DataFrame:
    """FASTA files to payload files, each of its file's first record, named by the file with _decoded.bin in place of its extension:
    (name, method, fec, corrected, uncorrectable, n_bad_blocks, warning, error).

    A row that can't be decoded has an error and no file; files without a record have no row.  warning tells of a protection
    that could not be undone, whose content is written as it is.
    """
    records = fasta.read(spark, paths, first_only=True, names=names).select(F.col("path").alias("id"), "header", "sequence")
    rows = decode_table(records, k, warnings=True).withColumn("name", metrics.decoded_name(F.col("id"))).withColumn("n_bad_blocks", F.size("bad_blocks"))
    return _filed(spark, rows, folder, "method", "fec", "corrected", "uncorrectable", "n_bad_blocks", "warning", "error")


def _filed(spark: SparkSession, rows: DataFrame, folder: str, *about: str) -> DataFrame:
    """Rows, computed once, with their contents written under their names: (name, about..., error)."""
    where = shared(spark, "files")  # contents are written, and their report is read, from these
    rows.write.parquet(where)
    rows = spark.read.schema(rows.schema).parquet(where)
    report = named.write(rows.where("error is null") if "error" in rows.columns else rows, folder).select(F.col("name").alias("_name"), F.col("error").alias("_error")).distinct()
    joined = rows.drop("content").join(report, rows["name"] == report["_name"], "left")
    error = F.coalesce("error", "_error") if "error" in rows.columns else F.col("_error")
    return joined.select("name", *[c for c in about if c != "error"], error.alias("error"))


#: Where `decode_into` puts rows that were decoded, and those that were not.
DECODED, QUARANTINED = "decoded", "quarantined"


def decode_into(df: DataFrame, folder: str, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decode a table into a folder: (decoded rows, quarantined rows, report), of one evaluation of df.

    Rows without an error go to the part status=decoded of the folder, the others to status=quarantined, both as Parquet.  While
    they are written their corrections are summed: the report has (method, fec, n_rows, n_errors, corrected, uncorrectable,
    bad_blocks) for each method and code that occurs, null for others than the known ones.
    """
    spark = df.sparkSession
    out = decode_table(df, k).withColumn("status", F.when(F.col("error").isNull(), DECODED).otherwise(QUARANTINED))
    sums = {"n_rows": F.lit(1), "n_errors": F.when(F.col("error").isNotNull(), 1).otherwise(0), "corrected": F.col("corrected"), "uncorrectable": F.col("uncorrectable"), "bad_blocks": F.size("bad_blocks")}
    kinds = [(m, c) for m in (*METHODS, None) for c in CODES]
    known = lambda c, names: F.when(F.col(c).isin(*[n for n in names if n]), F.col(c))
    of = lambda m, c: known("method", METHODS).eqNullSafe(F.lit(m)) & known("fec", CODES).eqNullSafe(F.lit(c))
    seen = Observation()
    metrics_of = [F.coalesce(F.sum(F.when(of(m, c), v)), F.lit(0)).cast("long").alias(f"{i}_{n}") for i, (m, c) in enumerate(kinds) for n, v in sums.items()]
    out.observe(seen, *metrics_of).write.partitionBy("status").parquet(folder)
    rows = [(m, c, *[seen.get[f"{i}_{n}"] for n in sums]) for i, (m, c) in enumerate(kinds) if seen.get[f"{i}_n_rows"]]
    report = spark.createDataFrame(rows, "method string, fec string, " + ", ".join(f"{n} long" for n in sums))
    written = spark.read.schema(out.schema).parquet(folder)
    part = lambda status: written.where(F.col("status") == status).drop("status")
    return part(DECODED), part(QUARANTINED), report


def audit(original: DataFrame, decoded: DataFrame, key: str = "id") -> DataFrame:
    """(id, status) of a round trip: same, differs, lost (not decoded) or extra (not among the originals).

    A null key is a key.  Rows of a repeated key are matched as often as both sides have the same content (same); of what is
    left, as many as both sides have differ, and the rest is lost or extra.  Counts of (id, digest) are shuffled, so many rows
    of one key are few.
    """
    side = lambda df, a, b: df.select(key, F.sha2("content", 256).alias("_digest"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    both = side(original, 1, 0).union(side(decoded, 0, 1)).groupBy(key, "_digest").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    same = F.least("_a", "_b")
    sums = both.groupBy(key).agg(F.sum(same).alias("same"), F.sum(F.col("_a") - same).alias("_a"), F.sum(F.col("_b") - same).alias("_b"))
    differ = F.least("_a", "_b")
    counts = {"same": F.col("same"), "differs": differ, "lost": F.col("_a") - differ, "extra": F.col("_b") - differ}
    listed = F.filter(F.array(*[F.struct(F.lit(s).alias("status"), n.alias("n")) for s, n in counts.items()]), lambda x: x["n"] > 0)
    each = sums.select(key, F.explode(listed).alias("s")).select(key, "s.*")
    blocks = each.select(key, "status", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1000))).alias("_block"))
    return blocks.select(key, F.explode(F.array_repeat("status", F.least(F.lit(1000), F.col("n") - F.col("_block") * 1000).cast("int"))).alias("status"))


def lost(original: DataFrame, decoded: DataFrame, key: str = "id") -> DataFrame:
    """Originals without a decoded row."""
    return original.join(decoded.select(key).distinct(), key, "left_anti")
