"""FASTA headers of encoded payloads: space-separated key=value pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "method string, input_file string, fec string, fec_padding_bits int, parity_k int, parity_rule string, gc_min double, gc_max double, max_homopolymer int, huffman_params struct<table:map<string,string>,padding:int>"


def _clean(name: Column) -> Column:
    """A name without white space, so that it can't be read as other fields."""
    return F.regexp_replace(name, r"\s+", "_")


def build(method: Column, input_file: Column, fec: Column | None = None, fec_padding_bits: Column | None = None, huffman_params: Column | None = None, parity_k: Column | None = None, parity_rule: Column | None = None, gc_min: Column | None = None, gc_max: Column | None = None, max_homopolymer: Column | None = None) -> Column:
    """A header; fields that are null or not given are left out.  huffman_params is a struct of table and padding."""
    pairs = {"method": method, "input_file": _clean(input_file), "fec": fec, "fec_padding_bits": fec_padding_bits, "parity_k": parity_k, "parity_rule": parity_rule, "gc_min": gc_min, "gc_max": gc_max, "max_homopolymer": max_homopolymer}
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in pairs.items() if v is not None]
    if huffman_params is not None:
        parts.append(F.when(huffman_params.isNotNull(), F.concat(F.lit("huffman_params="), F.to_json(huffman_params))))
    return F.concat_ws(" ", *parts)


def _value(header: Column, key: str, pattern: str = r"\S+") -> Column:
    found = F.regexp_extract(header, rf"(?:^|\s){key}=({pattern})", 1)
    return F.when(found != "", found)


def parse(header: Column) -> Column:
    """A struct of FIELDS; keys count only at the start of a word, missing ones and unreadable numbers are null."""
    number = r"-?[0-9]+(?:\.[0-9]+)?"
    method = F.when(_value(header, "method") == "base_4_direct", "base4_direct").otherwise(_value(header, "method"))
    json = F.regexp_extract(header, r"(?:^|\s)huffman_params=(\{.*\})", 1)
    params = F.when(json != "", F.from_json(json, "table map<string,string>, padding int"))
    return F.struct(
        method.alias("method"), _value(header, "input_file").alias("input_file"), _value(header, "fec").alias("fec"), _value(header, "fec_padding_bits", "-?[0-9]{1,9}(?![0-9])").cast("int").alias("fec_padding_bits"),
        _value(header, "parity_k", "-?[0-9]{1,9}(?![0-9])").cast("int").alias("parity_k"), _value(header, "parity_rule").alias("parity_rule"), _value(header, "gc_min", number).cast("double").alias("gc_min"),
        _value(header, "gc_max", number).cast("double").alias("gc_max"), _value(header, "max_homopolymer", "-?[0-9]{1,9}(?![0-9])").cast("int").alias("max_homopolymer"), params.alias("huffman_params"),
    )
