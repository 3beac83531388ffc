"""Rows that repeat, and ids that several rows have."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import minhash, queries


def _words(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"large": 2}, {"hot_members": 1}])
def test_an_id_with_two_texts_keeps_the_links_of_both(spark, options):
    rng = random.Random(2)
    a, b, c = (_words(rng, 90) for _ in range(3))
    near = lambda w: " ".join([*w[:40], "changed", *w[41:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, " ".join(b)), (7, near(b)), (9, " ".join(c)), (9, " ".join(c)), (None, " ".join(a)), (None, None), (8, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    groups = sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr)
    assert groups == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (7, 1, False), (9, 9, True), (9, 9, True), (None, None, True), (None, None, True), (8, 8, True)], key=repr)


def test_repeated_pages_are_resolved_as_often_as_they_stand_there(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i % 4}", f"<p>{i}</p>") for i in range(5000, 5020)], "page_id long, url string, html string")
    for name, df in (("once", pages), ("twice", pages.union(pages))):
        df.write.parquet(str(tmp_path / name / "pages.parquet"))
    count = lambda name: {r.outcome: r.n for r in queries.op4_revisits(spark, str(tmp_path / name)).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    once = count("once")
    assert sum(once.values()) == 20 and count("twice") == {o: 2 * n for o, n in once.items()}
