"""FASTA, Huffman, statistics, jobs and streams over small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import huffman, statistics
from helixframe.plans import jobs
from helixframe.sources import fasta, payloads
from helixframe.streaming import files


def test_fasta_records(spark):
    cases = {
        ">seq4\nAT GC\n GT CA ": [("seq4", "ATGCGTCA")],
        "  >seqF Header  \n  ATGC  \n  GTCA  \n": [("seqF Header", "ATGCGTCA")],
        "ATGC\n>seq1\nCGTA": [("seq1", "CGTA")],
        ">seq1\n>seq2\n>seq3": [("seq1", ""), ("seq2", ""), ("seq3", "")],
        "ATGC\nATGC": [],
        "": [],
        ">a\r\nAT\r\n\r\nGC\r\n": [("a", "ATGC")],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, value string")
    rows = fasta.records(df, keep=("i",)).orderBy("i", "record_no").collect()
    for i, want in enumerate(cases.values()):
        assert [(r.header, r.sequence) for r in rows if r.i == i] == want


def test_fasta_files(spark, tmp_path):
    df = spark.createDataFrame([("h", "ATGCATGCA"), ("e", "")], "header string, sequence string")
    assert [r[0] for r in df.select(fasta.to_text(F.col("header"), F.col("sequence"), 4)).collect()] == [">h\nATGC\nATGC\nA\n", ">e\n"]
    fasta.write(df.coalesce(1), str(tmp_path / "out"), 4)
    assert [(r.record_no, r.header, r.sequence) for r in fasta.read(spark, str(tmp_path / "out")).orderBy("record_no").collect()] == [(0, "h", "ATGCATGCA"), (1, "e", "")]
    assert fasta.read(spark, str(tmp_path / "out"), first_only=True).count() == 1
    with pytest.raises(ValueError):
        fasta.to_text(F.col("header"), F.col("sequence"), 0)


def test_payload_files(spark, tmp_path):
    for name, content in (("a.bin", b"\0\xff"), ("b.bin", b"b")):
        (tmp_path / name).write_bytes(content)
    rows = payloads.read_files(spark, [str(tmp_path / "a.bin"), str(tmp_path / "b.bin")]).collect()
    assert sorted((r.path.rsplit("/")[-1], r.length, bytes(r.content)) for r in rows) == [("a.bin", 2, b"\0\xff"), ("b.bin", 1, b"b")]
    payloads.write(payloads.read_files(spark, str(tmp_path / "a.bin")), str(tmp_path / "out"))
    assert bytes(spark.read.parquet(str(tmp_path / "out")).first().content) == b"\0\xff"


def test_huffman(spark):
    cases = [(1, b"AAAAA"), (2, b"aabbc"), (3, b"hello"), (4, b""), (5, bytes(range(256))), (6, None)]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in cases], "id long, content binary")
    got = {r.id: r for r in huffman.encode(df, "id").collect()}
    assert (got[1].dna, got[1].table, got[1].padding) == ("AAA", {"65": "0"}, 1)
    assert (got[2].dna, got[2].table, got[2].padding) == ("GGAC", {"97": "11", "98": "0", "99": "10"}, 0)
    assert (got[3].dna, got[3].table, got[3].padding) == ("ATGGC", {"104": "00", "101": "01", "108": "11", "111": "10"}, 0)
    assert (got[4].dna, got[4].table, got[4].padding) == ("", {}, 0)
    back = {r.id: r for r in huffman.decode(huffman.encode(df, "id")).collect()}
    assert all(back[i].error is None and (bytes(back[i].content) if c is not None else back[i].content) == c for i, c in cases)


def test_huffman_errors(spark):
    rows = [(1, "AGCX", {"65": "0"}, 0), (2, "A", {"65": "0"}, 3), (3, "T", {"65": "0"}, 1), (4, "A", {"88": "001"}, 0), (5, "A", {}, 0)]
    got = huffman.decode(spark.createDataFrame(rows, "id long, dna string, table map<string,string>, padding int")).collect()
    assert all(r.error and r.content is None for r in got)


def test_code_lengths(spark):
    df = spark.createDataFrame([("x", bytearray(b"aabbc")), ("x", bytearray(b"aa"))], "g string, content binary")
    books = huffman.code_books(huffman.byte_frequencies(df.withColumn("o", F.length("content")), "g", order="o"), "g")
    assert [(r.length, r.n_codes) for r in huffman.code_lengths(books).collect()] == [(1, 1), (2, 2)]


def test_nucleotides(spark):
    for text, want in (("AATXTCGY", (2, 2, 1, 1)), ("AAAA", (4, 0, 0, 0)), ("", (0, 0, 0, 0))):
        got = {r.base: r.n for r in statistics.nucleotide_counts(spark.createDataFrame([(text,)], "dna string")).collect()}
        assert tuple(got[b] for b in "ATCG") == want
    assert statistics.nucleotide_counts(spark.createDataFrame([], "dna string")).count() == 4


def test_sliding_gc(spark):
    def run(text, window, step):
        df = spark.createDataFrame([(1, text)], "id long, dna string")
        return [(r.window_start, r.gc) for r in statistics.sliding_gc(df, "id", window=window, step=step).orderBy("window_start").collect()]

    assert run("AAAAAGGGGGCCCCCTTTTT", 5, 5) == [(0, 0.0), (5, 1.0), (10, 1.0), (15, 0.0)]
    assert run("ATGCATGC", 5, 2) == [(0, 0.4), (2, 0.6)]
    assert run("AAANNGGG", 4, 1) == [(0, 0.0), (1, 0.0), (2, 0.5), (3, 1.0), (4, 1.0)]
    assert run("ATG", 5, 1) == []
    text = "ATGCCGTANNGCtagc"
    for window, step in ((4, 3), (5, 2), (6, 4)):
        want = []
        for s in range(0, len(text) - window + 1, step):
            w = text[s : s + window].upper()
            n = sum(c in "ATCG" for c in w)
            want.append((s, sum(c in "GC" for c in w) / n if n else 0.0))
        assert run(text, window, step) == want
    with pytest.raises(ValueError):
        run("A", 0, 1)


def test_homopolymers(spark):
    cases = {
        ("AAATTTTGGCC", 3): [(0, 2, "A"), (3, 6, "T")], ("TGCCCATT", 3): [(2, 4, "C")], ("AAAAGCTTTTCGGGGG", 4): [(0, 3, "A"), (6, 9, "T"), (11, 15, "G")],
        ("aaAAAttT", 3): [(0, 4, "A"), (5, 7, "T")], ("AAANNTTTT", 3): [(0, 2, "A"), (5, 8, "T")], ("", 2): [], ("ééé", 2): [(0, 2, "É")],
    }
    for (text, n), want in cases.items():
        df = spark.createDataFrame([(1, text), (2, None)], "id long, dna string")
        for f in (statistics.homopolymer_regions, statistics.homopolymer_regions_by_window):
            assert [(r.start_pos, r.end_pos, r.base) for r in f(df, "id", min_len=n).orderBy("start_pos").collect()] == want
    with pytest.raises(ValueError):
        statistics.homopolymer_regions(df, "id", min_len=1)


PAYLOADS = [(1, "a b", b"Hello, world"), (2, "b", b""), (3, "c", bytes(range(256))), (4, "d", "é日本".encode())]


@pytest.mark.parametrize("method,fec", list(itertools.product(jobs.METHODS, jobs.CODES)))
def test_round_trip(spark, method, fec):
    df = spark.createDataFrame([(i, n, bytearray(c)) for i, n, c in PAYLOADS], "id long, name string, content binary")
    status = {r.id: r.status for r in jobs.audit(df, jobs.decode_table(jobs.encode_table(df, method, fec, add_parity=True, k=3))).collect()}
    assert status == {1: "same", 2: "differs" if method == "gc_balanced" else "same", 3: "same", 4: "same"}


def test_isolation_and_audit(spark):
    rows = [(1, "method=base4_direct", "TAAT"), (2, "method=base4_direct", "TAA"), (3, "method=other", "TAAT"), (4, "nothing", "TAAT"), (5, "method=base4_direct fec=triple_repeat", "TTTAA")]
    got = {r.id: r for r in jobs.decode_table(spark.createDataFrame(rows, "id long, header string, sequence string")).collect()}
    assert bytes(got[1].content) == b"A" and got[1].error is None
    assert all(got[i].content is None and got[i].error for i in (2, 3, 4, 5))
    a = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"y"))], "id long, content binary")
    b = spark.createDataFrame([(1, bytearray(b"z")), (3, bytearray(b"y"))], "id long, content binary")
    assert {r.id: r.status for r in jobs.audit(a, b).collect()} == {1: "differs", 2: "lost", 3: "extra"}
    assert [r.id for r in jobs.lost(a, b).collect()] == [2]


def test_more_block_lengths_than_a_thousand(spark):
    dna, rows = "ATCG" * 400, []
    for k in range(1, 1201):
        blocks = [dna[i : i + k] for i in range(0, len(dna), k)]
        coded = "".join(b + "AT"[(b.count("G") + b.count("C")) % 2] for b in blocks)
        rows.append((k, f"method=base4_direct input_file=f parity_k={k} parity_rule=GC_even_A_odd_T", coded))
    rows.append((5000, "method=base4_direct input_file=f parity_k=999999999 parity_rule=GC_even_A_odd_T", dna + "A"))
    got = jobs.decode_table(spark.createDataFrame(rows, "id long, header string, sequence string")).collect()
    assert len(got) == 1201 and len({bytes(r.content) for r in got}) == 1 and all(len(r.content) == 400 and r.error is None and not r.bad_blocks for r in got)


def test_report_and_rollup(spark):
    df = spark.createDataFrame([(i, n, bytearray(c)) for i, n, c in PAYLOADS], "id long, name string, content binary")
    coded = jobs.encode_table(df, fec="triple_repeat")
    hurt = coded.withColumn("sequence", F.regexp_replace("sequence", "^.", "X"))
    report = statistics.correction_report(jobs.decode_table(hurt), "method", "fec").first()
    assert (report.n_rows, report.corrected, report.uncorrectable, report.bad_blocks) == (4, 3, 0, 0)
    total = [r for r in statistics.metrics_rollup(coded, "name").collect() if r.name is None][0]
    assert (total.n_payloads, total.n_nt, total.bits_per_nt) == (4, total.n_bytes * 12, pytest.approx(2 / 3))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"Hi")
    files.encode_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.sequence == "TACATCCT" and "input_file=a.bin" in row.header


def test_null_keys_keep_their_payloads(spark):
    rows = spark.createDataFrame([(1, "en", b"hello"), (None, None, b"hello"), (2, None, b"abc"), (3, "de", b"")], "id long, lang string, content binary")
    for group in ("id", "lang"):
        coded = huffman.encode(rows, group, order="id")
        got = sorted((r.id or 0, bytes(r.content), r.error) for r in huffman.decode(coded).collect())
        assert got == [(0, b"hello", None), (1, b"hello", None), (2, b"abc", None), (3, b"", None)]
    decoded = jobs.decode_table(jobs.encode_table(rows.withColumn("name", F.lit("x")), "huffman"))
    assert {(r.id, r.status) for r in jobs.audit(rows, decoded).collect()} == {(i, "same") for i in (None, 1, 2, 3)}


def test_headers_that_cannot_be_followed_are_errors(spark):
    ok = "method=base4_direct input_file=x parity_k=7 parity_rule=GC_even_A_odd_T"
    heads = [ok, ok.replace("GC_even_A_odd_T", "other"), ok.replace("parity_k=7", "parity_k=0"), ok.replace("parity_k=7 ", "")]
    sequence = jobs.encode_table(spark.createDataFrame([(0, "x", b"ABCDEFG")], "id long, name string, content binary"), add_parity=True).first().sequence
    rows = spark.createDataFrame([(i, h, sequence) for i, h in enumerate(heads)], "id long, header string, sequence string")
    got = {r.id: r for r in jobs.decode_table(rows).collect()}
    assert bytes(got[0].content) == b"ABCDEFG" and got[0].error is None
    assert all(got[i].content is None and got[i].error for i in (1, 2, 3))
    empty = spark.createDataFrame([(1, "", {"65": "0"}, 0), (2, "", {}, 0)], "id long, dna string, table map<string,string>, padding int")
    assert {r.id: (r.content, r.error is None) for r in huffman.decode(empty).collect()} == {1: (None, False), 2: (b"", True)}


def test_huffman_walks_long_and_bad_tables(spark):
    weights = [1, 1]
    while len(weights) < 24:  # Fibonacci numbers, whose codes are as long as can be
        weights.append(weights[-1] + weights[-2])
    codes = huffman.codes_of(weights)
    assert max(map(len, codes)) > huffman.LOOKUP
    table = {str(65 + i): c for i, c in enumerate(codes)}
    content = bytes(65 + i for i in (*range(24), *range(23, -1, -1), 0, 0, 23))
    bits = "".join(codes[b - 65] for b in content)
    padding = len(bits) % 2
    dna = "".join("ATCG"[int((bits + "0" * padding)[i : i + 2], 2)] for i in range(0, len(bits), 2))
    rows = [(1, dna, table, padding), (2, "A", {"65": "0x"}, 0), (3, "A", {"300": "0"}, 0), (4, "GG", {"65": "0", "66": "10"}, 0), (5, "AT", {"65": "000", "66": "11"}, 0)]
    got = {r.id: (bytes(r.content) if r.content is not None else None, r.error) for r in huffman.decode(spark.createDataFrame(rows, "id long, dna string, table map<string,string>, padding int")).collect()}
    assert got == {1: (content, None), 2: (None, "bad code table"), 3: (None, "bad code table"), 4: (None, "bits are left over"), 5: (None, "bits are left over")}


def test_many_block_lengths_in_one_table(spark):
    rows = spark.range(1200).select("id", F.concat(F.lit("payload "), "id").alias("text"))
    plain = jobs.encode_table(payloads.from_text(rows, "id", "text").withColumn("name", F.lit("x"))).drop("name")
    parts = plain.collect()

    def added(seq, k):
        blocks = [seq[i : i + k] for i in range(0, len(seq), k)]
        return "".join(b + "AT"[sum(c in "GC" for c in b) % 2] for b in blocks)

    coded = [(r.id, f"{r.header} parity_k={r.id + 1} parity_rule=GC_even_A_odd_T", added(r.sequence, r.id + 1)) for r in parts]
    decoded = jobs.decode_table(spark.createDataFrame(coded, "id long, header string, sequence string"))
    assert sorted((r.id, bytes(r.content), r.bad_blocks) for r in decoded.collect()) == [(i, f"payload {i}".encode(), []) for i in range(1200)]


def test_rows_of_one_id_have_their_own_code_books(spark):
    rows = spark.createDataFrame([(1, "n", bytearray(b"aab")), (1, "n", bytearray(b"zzzy")), (None, "n", bytearray(b"q")), (2, "n", None)], "id long, name string, content binary")
    decoded = jobs.decode_table(jobs.encode_table(rows, "huffman")).collect()
    assert sorted((r.id or 0, bytes(r.content or b"")) for r in decoded) == [(0, b"q"), (1, b"aab"), (1, b"zzzy"), (2, b"")]


def test_byte_places_in_a_group_of_many_rows(spark):
    rows = [(i, g, None if c is None else bytearray(c)) for i, (g, c) in enumerate([("a", b"xyx"), (None, b"y"), ("a", b"zy"), ("b", b""), (None, b"yyq"), ("a", None)])]
    got = huffman.byte_frequencies(spark.createDataFrame(rows, "id long, g string, content binary").repartition(3), "g", order="id").collect()
    assert sorted((r.g or "", chr(r.byte), r.n, r["first"][0], r["first"][1]) for r in got) == [("", "q", 1, 4, 2), ("", "y", 3, 1, 0), ("a", "x", 2, 0, 0), ("a", "y", 2, 0, 1), ("a", "z", 1, 2, 0)]


def test_sequences_beyond_ascii(spark):
    df = spark.createDataFrame([(1, "GGGGééééA"), (2, ""), (3, None), (4, "éAAAA")], "id long, dna string")
    assert sorted(tuple(r) for r in statistics.homopolymer_regions(df, "id").collect()) == [(1, 0, 3, "G"), (1, 4, 7, "É"), (4, 1, 4, "A")]
    assert sorted(tuple(r) for r in statistics.sliding_gc(df, "id", window=5, step=4).collect()) == [(1, 0, 1.0), (1, 4, 0.0), (4, 0, 0.0)]


@pytest.mark.parametrize("method", jobs.METHODS)
@pytest.mark.parametrize("fec", jobs.CODES)
def test_a_batch_is_coded_in_parts(method, fec):
    """One step of each way codes a batch of any size, in parts of bounded size, by rows that have several kinds of nulls."""
    import pyarrow as pa

    from helixframe.functions import flat

    rng = random.Random(5)
    payloads = [None, b"", *[rng.randbytes(rng.randrange(1, 900)) for _ in range(60)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(payloads))), pa.array(payloads, pa.binary())], ["id", "content"])
    parts = list(flat.sliced(batch, "content", 4000))
    assert len(parts) > 5 and all(p.num_rows == 1 or sum(len(c or b"") for c in p.column("content").to_pylist()) <= 4000 for p in parts)
    assert [c for p in parts for c in p.column("content").to_pylist()] == payloads
    coded = [x for p in parts for x in jobs.coded(p.column("content"), method, fec, True)[0].to_pylist()]
    whole = jobs.coded(batch.column("content"), method, fec, True)[0].to_pylist()
    assert coded == whole and whole[0] is None
