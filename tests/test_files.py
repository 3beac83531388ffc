"""FASTA files over many byte ranges, and files written under their names."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.plans import jobs, queries
from helixframe.sources import fasta, folders, named, payloads


@pytest.fixture
def ranges_of(spark):
    """Have files read in ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def to(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield to
    for name, value in old.items():
        spark.conf.set(name, value)


def _texts():
    rng = random.Random(8)
    dna = lambda n: "".join(rng.choice("ATCG") for _ in range(n))
    long = "\n".join(dna(60) for _ in range(12))
    return {
        "plain.fa": "".join(f">seq{i} x\n" + "\n".join(dna(rng.randint(0, 70)) for _ in range(rng.randint(0, 5))) + "\n" for i in range(12)),
        "long.fa": f"dropped\nlines\n>one\n{long}\n>two\nAT GC\n>three\n{long}\n{long}",
        "crlf.fa": f">a  \r\nAT\r\n\r\nGC\r\n  > b b\t\r\n{dna(120)}\r\n \r\nTT\r\n>c\r\n",
        "odd.fa": ">h>h\nAC>GT\n\t >i AT  >j\nGG\u0085>k T\n>\n>\n\n>end\n  A C\x0bG\f\n",
        "none.fa": "ATGC\nATGC\n", "heads.fa": ">s1\n>s2\n>s3", "one_line.fa": ">w\n" + dna(900) + "\n>x\n" + dna(10),
    }


@pytest.mark.parametrize("size, fragment", [(400, 64), (900, fasta.FRAGMENT), (1 << 20, 10)])
def test_ranges_give_the_records_of_the_whole(spark, tmp_path, ranges_of, size, fragment):
    texts = _texts()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    whole = spark.createDataFrame(list(texts.items()), "path string, value string")
    want = sorted(map(tuple, fasta.records(whole, keep=("path",)).collect()))
    ranges_of(size)
    got = fasta.read(spark, str(tmp_path), fragment=fragment)
    assert sorted((r.path.rsplit("/", 1)[-1], r.record_no, r.header, r.sequence) for r in got.collect()) == want
    if size < 500:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    pieces = fasta.read_pieces(spark, str(tmp_path), fragment).collect()
    by = {}
    for r in sorted(pieces, key=lambda r: (r.path, r.record_no, r.piece)):
        so_far = by.setdefault((r.path.rsplit("/", 1)[-1], r.record_no), [r.header, ""])
        assert (r.start, r.header) == (len(so_far[1]), so_far[0])
        so_far[1] += r.sequence
    assert sorted((*k, *v) for k, v in by.items()) == want
    first = fasta.read(spark, str(tmp_path), first_only=True, fragment=fragment).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.record_no, r.header, r.sequence) for r in first) == [w for w in want if w[1] == 0]


def test_whole_records_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nAT\n>b\nGC\n>c\nTT\n")
    rows = fasta.read_pieces(spark, str(tmp_path / "a.fa")).select("record_no", "header", "piece", "sequence")
    assert sorted(map(tuple, rows.collect())) == [(0, "a", 0, "AT"), (1, "b", 0, "GC"), (2, "c", 0, "TT")]
    assert rows.where(F.col("header") == "none").count() == 0


def _listed(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if p.is_file() and not p.name.startswith(".")}


def test_files_under_their_names(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"old")
    (tmp_path / "kept.bin").write_bytes(b"kept")
    rows = [("a.bin", b"\0\xff"), ("b.bin", b""), ("twice.bin", b"1"), ("Twice.bin", b"2"), ("none.bin", None), (None, b"x"), ("../c.bin", b"x"), ("..", b"x"), ("", b"x"), ("é ü.bin", b"long" * 1000)]
    df = spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in rows], "name string, content binary").repartition(3)
    report = {(r.name, r.n_bytes): r.error for r in named.write(df, str(tmp_path)).collect()}
    assert {n for (n, _), e in report.items() if e is None} == {"a.bin", "b.bin", "é ü.bin"} and len(report) == len(rows)
    assert report["twice.bin", 1] == report["Twice.bin", 1] == "several rows have the name"
    assert _listed(tmp_path) == {"a.bin": b"\0\xff", "b.bin": b"", "é ü.bin": b"long" * 1000, "kept.bin": b"kept"}
    assert not list((tmp_path / named.STAGING).iterdir())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.range(20, numPartitions=4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no"):
        named.write(df.withColumn("content", F.coalesce("content", F.lit(b"y"))), str(tmp_path))
    assert not _listed(tmp_path)
    staging = tmp_path / named.STAGING / "job"
    late = spark.range(2000, numPartitions=4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 1999, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no"):  # when other tasks have written their files
        named.stage(late, str(staging))
    assert not staging.exists()


def test_publishing_can_be_repeated(spark, tmp_path):
    staging = tmp_path / named.STAGING / "job"
    (staging / "done-1").mkdir(parents=True)
    (staging / "attempt-2").mkdir()
    (staging / "done-1" / "a").write_bytes(b"new")
    (staging / "attempt-2" / "b").write_bytes(b"of a lost attempt")
    (tmp_path / "moved before").write_bytes(b"1")
    for _ in range(2):
        named.publish(spark, str(tmp_path), str(staging))
        assert _listed(tmp_path) == {"a": b"new", "moved before": b"1"}


@pytest.mark.parametrize("options", [{"method": "base4_direct", "fec": "triple_repeat", "add_parity": True}, {"method": "huffman", "fec": "hamming_7_4"}])
def test_files_to_files(spark, tmp_path, options):
    contents = {"one.txt": b"hello \xff\0", "two.tar.gz": bytes(range(256)) * 9, "three": b"3"}
    (tmp_path / "in").mkdir()
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)
    report = {r.name: r for r in jobs.encode_files(spark, str(tmp_path / "in"), str(tmp_path / "dna"), **options).collect()}
    assert set(report) == {f"{n}.fasta" for n in contents} == set(_listed(tmp_path / "dna")) and all(r.error is None and r.n_nt > 0 for r in report.values())
    text = _listed(tmp_path / "dna")["two.tar.gz.fasta"].decode().split("\n")
    assert text[0].startswith(f">method={options['method']} input_file=two.tar.gz") and max(map(len, text[1:])) == 80
    (tmp_path / "dna" / "bad.fasta").write_text(">method=base4_direct input_file=bad\nATX\n")
    (tmp_path / "dna" / "two.fasta").write_text(">method=base4_direct input_file=two\nTAAT\n>second\nAAAA\n")
    (tmp_path / "dna" / "no.fasta").write_text("nothing\n")
    rows = {r.name: r for r in jobs.decode_files(spark, str(tmp_path / "dna"), str(tmp_path / "back")).collect()}
    assert rows["bad_decoded.bin"].error == "invalid nucleotide" and "no_decoded.bin" not in rows
    assert _listed(tmp_path / "back") == {"one.txt_decoded.bin": contents["one.txt"], "two.tar.gz_decoded.bin": contents["two.tar.gz"], "three_decoded.bin": b"3", "two_decoded.bin": b"A"}


def test_decoding_into_two_places(spark, tmp_path):
    rows = [(1, "method=base4_direct input_file=a", "TAAT"), (2, "method=base4_direct input_file=b fec=triple_repeat", "TTTAAAAAATTG"), (3, "method=none", "TAAT"), (4, "method=base4_direct", "TAAX"), (5, None, None)]
    good, bad, report = jobs.decode_into(spark.createDataFrame(rows, "id long, header string, sequence string"), str(tmp_path / "out"))
    assert {r.id: bytes(r.content) for r in good.collect()} == {1: b"A", 2: b"A"}
    assert {r.id: r.error for r in bad.collect()}.keys() == {3, 4, 5}
    got = {(r.method, r.fec): tuple(r)[2:] for r in report.collect()}
    assert got == {("base4_direct", None): (2, 1, 0, 0, 0), ("base4_direct", "triple_repeat"): (1, 0, 1, 0, 0), (None, None): (2, 2, 0, 0, 0)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["status=decoded", "status=quarantined"]


def test_audit_of_repeated_ids(spark):
    a = [(1, b"a")] * 2500 + [(1, b"b"), (2, b"x"), (3, b"x"), (3, b"x"), (None, b"n"), (None, b"m"), (4, None)]
    b = [(1, b"a")] * 2400 + [(1, b"c"), (2, b"y"), (3, b"x"), (5, b"z"), (None, b"n"), (4, None)]
    frame = lambda rows: spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in rows], "id long, content binary")
    got = {(r.id, r.status): r.n for r in jobs.audit(frame(a), frame(b)).groupBy("id", "status").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "same"): 2400, (1, "differs"): 1, (1, "lost"): 100, (2, "differs"): 1, (3, "same"): 1, (3, "lost"): 1, (None, "same"): 1, (None, "lost"): 1, (4, "same"): 1, (5, "extra"): 1}


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """A folder of many files is listed once, not by a task for each, and a task reads more than 32 of them."""
    docs = spark.createDataFrame([(i, f"text {i}", "de" if i % 2 else "en") for i in range(400)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    context = spark.sparkContext
    context.setJobGroup("small files", "")
    try:
        found = queries.s3_several_folders(spark, str(tmp_path))
        parts = found.rdd.getNumPartitions()
        assert found.count() == 400
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("small files") for s in tracker.getJobInfo(j).stageIds]
    assert parts <= 8 and sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s))) < 200


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """Before, Spark's sources listed every file in the driver, and kept the list as long as the DataFrame."""
    (tmp_path / "in" / "deep").mkdir(parents=True)
    want = {"a b.txt": b"\xff\0", "deep/c.txt": b"c" * 9_000_000, "d.gz.txt": b"d"}
    for name, content in {**want, "none.txt": b"", "e.bin": b"e", "_f.txt": b"f", ".g.txt": b"g"}.items():
        (tmp_path / "in" / name).write_bytes(content)
    top = str(tmp_path / "in")
    got = payloads.read_files(spark, [top], "*.txt")
    assert not any(f.endswith(".txt") for f in got.inputFiles())  # no file source of Spark's has them
    assert {r.path: (r.length, bytes(r.content)) for r in got.collect()} == {f"file:{top}/{n}": (len(c), c) for n, c in want.items()}
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(top)
    assert {tuple(r) for r in got.select("path", "length").collect()} == {tuple(r) for r in theirs.select("path", "length").collect()}
    assert folders.listed(spark, f"{top}/*.txt") is None and folders.listed(spark, f"{top}/e.bin") is None and folders.listed(spark, top, "[a]*") is None
    many = tmp_path / "fasta"
    many.mkdir()
    for i in range(5):
        (many / f"{i}.fasta").write_text(f"junk\n >n{i} \r\nAC GT\n\nA\n>second\nT\n" + (">third\n" + "ACGT\n" * 200 if i == 3 else ""))
    small, folders.SMALL = folders.SMALL, 500
    try:
        assert any("/fasta-" in f for f in fasta.read(spark, str(many), first_only=True).inputFiles())  # the large one by byte ranges
        for first in (True, False):
            rows = lambda df: sorted((r.path.rsplit("/", 1)[-1], r.record_no, r.header, r.sequence) for r in df.collect())
            assert rows(fasta.read(spark, str(many), first_only=first)) == rows(fasta.read(spark, f"{many}/*.fasta", first_only=first))
    finally:
        folders.SMALL = small
