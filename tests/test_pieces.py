"""Sequences in pieces: the rows of the whole, wherever the borders lie."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import hamming, parity, repeat
from helixframe.operators import huffman, pieces, statistics


@pytest.fixture(scope="module")
def sequences(spark):
    rng = random.Random(3)
    runs = lambda n: "".join(rng.choice("ATCGatcgNé") * rng.choice([1, 1, 2, 3, 4, 9, 30]) for _ in range(n))
    rows = [(i, runs(rng.randint(0, 40))) for i in range(12)] + [(20, "A" * 200), (21, ""), (22, None), (23, "AT"), (None, runs(20))]
    return spark.createDataFrame(rows, "id long, dna string").cache()


@pytest.mark.parametrize("size", [1, 40])
def test_pieces_give_the_rows_of_the_whole(sequences, size):
    parts = pieces.cut(sequences, "id", "dna", size).withColumn("piece", F.col("piece") * 10 - 3).repartition(3)
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    for window, step in ((1, 1), (4, 3), (50, 10)):
        if size == 1 and window > 4:
            continue
        assert plain(pieces.sliding_gc(parts, "id", window=window, step=step)) == plain(statistics.sliding_gc(sequences, "id", window=window, step=step))
    for least in (2, 4) if size < 40 else (4,):
        assert plain(pieces.homopolymer_regions(parts, "id", min_len=least)) == plain(statistics.homopolymer_regions(sequences, "id", min_len=least))


def test_halo_over_short_and_empty_pieces(spark):
    rows = [("s", 1, "AB"), ("s", 2, ""), ("s", 4, "C"), ("s", 5, "DEFGH"), ("s", 6, "I"), ("t", 1, "XY")]
    got = pieces.with_halo(spark.createDataFrame(rows, "id string, piece int, dna string"), "id", "piece", "dna", 4).collect()
    assert sorted((r.id, r.piece, r.at, r.start, r.length, r.tail) for r in got) == [("s", 1, 0, 0, 2, "CDEF"), ("s", 4, 1, 2, 1, "DEFG"), ("s", 5, 2, 3, 5, "I"), ("s", 6, 3, 8, 1, ""), ("t", 1, 0, 0, 2, "")]


def test_bad_arguments(sequences):
    for call in (lambda: pieces.sliding_gc(sequences, "id", window=0), lambda: pieces.homopolymer_regions(sequences, "id", min_len=1)):
        with pytest.raises(ValueError):
            call()


def _payloads():
    rng = random.Random(12)
    skewed = bytes(b for b in range(20) for _ in range(2 ** min(b, 13)))  # codes of many lengths, up to 19 bits and more
    deep = bytes(rng.sample(skewed, len(skewed) // 4)) + bytes(range(20))
    return [(1, b"aabbc" * 40), (2, bytes(rng.randrange(256) for _ in range(700))), (3, b"AAAAA"), (4, deep), (5, b"x"), (6, b"")]


@pytest.mark.parametrize("size", [1, 300])
def test_a_payload_is_decoded_from_pieces(spark, size):
    rows = [(i, bytearray(c)) for i, c in _payloads() if size > 1 or len(c) < 300]
    coded = huffman.encode(spark.createDataFrame(rows, "id long, content binary"), "id").cache()
    parts = pieces.cut(coded, "id", "dna", size).repartition(3)
    got = {}
    for r in sorted(huffman.decode_pieces(parts, coded.select("id", "table", "padding")).collect(), key=lambda r: r["at"]):
        assert r.error is None
        got[r.id] = got.get(r.id, b"") + bytes(r.content)
    assert got == {i: bytes(c) for i, c in rows if c}


def test_pieces_that_can_not_be_decoded(spark):
    rows = [(1, "AGCXAA", {"65": "0"}, 0), (2, "AAA", {"65": "0"}, 3), (3, "AAT", {"65": "0"}, 1), (4, "AAAA", {"88": "001"}, 0), (5, "AA", {}, 0), (6, "AT", {"1": "00", "2": "01", "3": "1"}, 0), (7, "AA", {"300": "0"}, 0), (None, "AT", {"1": "00", "2": "01"}, 0)]
    df = spark.createDataFrame(rows, "id long, dna string, table map<string,string>, padding int")
    got = {r.id: r for r in huffman.decode_pieces(pieces.cut(df, "id", "dna", 2), df).collect()}
    want = {r.id: r for r in huffman.decode(df).collect()}
    assert got.keys() == want.keys()
    assert all((got[i].error, got[i].content) == (want[i].error, want[i].content) for i in want)


@pytest.mark.parametrize("groups", [huffman.GROUPS, 1])
def test_group_books_meet_payloads_without_a_shuffle_by_group(spark, groups):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 3 else None, bytearray(b"abc" * (i + 1))) for i in range(30)], "id long, g string, content binary")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = huffman.encode(df, "g", order="id", groups=groups)
        plan = coded._jdf.queryExecution().optimizedPlan().toString() + coded._jdf.queryExecution().executedPlan().toString()
        back = {r.id: bytes(r.content) for r in huffman.decode(coded).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert back == {i: b"abc" * (i + 1) for i in range(30)}
    assert ("BroadcastHashJoin" in plan) == (groups > 1) and ("_salt" in plan) == (groups == 1)
    if groups > 1:
        above = plan[plan.index("BroadcastHashJoin") :].split("InMemoryTableScan")[0]
        assert "Exchange hashpartitioning" not in above


def _put_together(df, value, *more):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["at"]):
        old = out.get(r["id"])
        new = (r[value], *(r[c] for c in more))
        out[r["id"]] = new if old is None else tuple(a + b for a, b in zip(old, new))
    return out


@pytest.mark.parametrize("size", [1, 5])
def test_block_codes_of_pieces(spark, size):
    rng = random.Random(9)
    rows = [(i, bytearray(rng.randrange(256) for _ in range(i)), "".join(rng.choice("ATCGé") for _ in range(i))) for i in (1, 2, 3, 4, 5, 8, 23)] + [(None, bytearray(b"null"), "GCGC"), (90, bytearray(), ""), (91, None, None)]
    df = spark.createDataFrame(rows, "id long, content binary, dna string").cache()
    filled = lambda rows: {k: v for k, *v in rows if v[0]}
    whole = df.select("id", hamming.encode(F.col("content")).alias("h")).select("id", "h.*").cache()
    coded = pieces.hamming_encode(pieces.cut(df, "id", "content", size).repartition(3), "id")
    assert _put_together(coded, "encoded", "padding") == {k: tuple(v) for k, v in filled(whole.collect()).items()}
    hurt = whole.withColumn("encoded", F.when(F.length("encoded") > 0, F.unhex(F.concat(F.lit("0"), F.substr(F.hex("encoded"), F.lit(2))))).otherwise(F.col("encoded")))
    plain = hurt.select("id", hamming.decode(F.col("encoded"), F.col("padding")).alias("d")).select("id", "d.*").collect()
    assert _put_together(pieces.hamming_decode(pieces.cut(hurt, "id", "encoded", size), hurt, "id"), "content", "corrected") == {k: tuple(v) for k, v in filled(plain).items()}
    for k in (1, 3):
        added = df.select("id", parity.add(F.col("dna"), k).alias("dna")).cache()
        assert _put_together(pieces.parity_add(pieces.cut(df, "id", "dna", size), "id", k=k), "dna") == {i: (d,) for i, d in added.collect() if d}
        other = added.withColumn("dna", F.translate("dna", "A", "T"))
        stripped = other.select("id", parity.strip(F.col("dna"), k).alias("s")).select("id", "s.*").collect()
        assert _put_together(pieces.parity_strip(pieces.cut(other, "id", "dna", size), "id", k=k), "dna", "bad_blocks") == {k: tuple(v) for k, v in filled(stripped).items()}
    tripled = df.select("id", F.regexp_replace(repeat.encode(F.col("dna")), "TTT", "TAT").alias("dna")).cache()
    voted = tripled.select("id", repeat.decode(F.col("dna")).alias("v")).select("id", "v.*").collect()
    assert _put_together(pieces.repeat_decode(pieces.cut(tripled, "id", "dna", size), "id"), "dna", "corrected", "uncorrectable") == {k: tuple(v) for k, v in filled(voted).items()}


def test_pieces_of_codes_of_a_bad_length(spark):
    parts = spark.createDataFrame([(1, 0, bytearray(b"abc")), (1, 1, bytearray(b"defgh")), (2, 0, bytearray(b"abcdefg"))], "id long, piece int, encoded binary")
    got = pieces.hamming_decode(parts, spark.createDataFrame([(1, 0)], "id long, padding int"), "id").collect()
    assert {(r.id, r.error, r.content) for r in got} == {(1, "bits are not a multiple of 7", None), (2, "no padding is given", None)}
    bad = pieces.repeat_decode(spark.createDataFrame([(1, 0, "AA"), (1, 1, "ATT")], "id long, piece int, dna string"), "id").collect()
    assert {(r.error, r.dna) for r in bad} == {("length is not a multiple of 3", None)}


def test_runs_over_many_pieces_of_a_long_sequence(spark):
    """Borders of all pieces are found in one pass: substrings from the start of the text took quadratic time."""
    whole = "ATTTTTCG" * 120_000 + "é" + "G" * 9
    df = spark.createDataFrame([(1, whole), (2, ""), (3, None)], "id long, dna string")
    parts = pieces.cut(df, "id", "dna", 1000)
    got = sorted((r.id, r.piece, r.dna) for r in parts.collect())
    assert [d for i, _, d in got if i == 1] == [whole[a : a + 1000] for a in range(0, len(whole), 1000)]
    assert [(i, p, d) for i, p, d in got if i != 1] == [(2, 0, "")]
    assert pieces.homopolymer_regions(parts, "id", min_len=5).count() == 120_001


def test_hamming_codes_in_pieces_are_made_twice_and_shuffled_once(spark):
    """One pass for lengths and heads, one for the codes; before, six passes made the pieces, and several joins moved them."""
    rng = random.Random(21)
    payloads = [(i, bytearray(rng.randrange(256) for _ in range(rng.randint(0, 90)))) for i in range(40)] + [(None, bytearray(b"xyz"))]
    coded = spark.createDataFrame(payloads, "id long, content binary").select("id", hamming.encode(F.col("content")).alias("h")).select("id", "h.*").cache()
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cut = pieces.cut(coded, "id", "encoded", 5).localCheckpoint()
    parts = cut.mapInArrow(counted, cut.schema)
    got = {}
    for r in sorted(pieces.hamming_decode(parts, coded, "id").collect(), key=lambda r: r["at"]):
        assert r.error is None
        got[r.id] = got.get(r.id, b"") + bytes(r.content)
    assert got == {i: bytes(c) for i, c in payloads if c}
    assert seen.value == 2 * cut.count()
