"""Registered queries with SQL against DuckDB, and the columns that the others return."""

import os

import pytest

from helixframe.llm import queries
from tests.sql_check import DATA, both

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")

COLUMNS = {
    "op1_suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10_katz": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    ours, theirs = both(spark, queries.QUERIES[name], queries.SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_a_document(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    assert out.columns == COLUMNS[name]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
