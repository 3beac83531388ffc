"""Folders that the driver and all executors share, and folders of many files, listed and read by tasks."""

from __future__ import annotations

import fnmatch
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession, name: str) -> str:
    """A new path for files of a job, in the folder that spark.checkpoint.dir names; a temporary one only for a local master."""
    context = spark.sparkContext
    top = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


#: What a task reads of small files: so many bytes, of which each file counts COST for being opened.
SHARE, COST = 128 << 20, 1 << 18
#: Files of at most so many bytes are small.
SMALL = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system that pyarrow opens, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _hidden(name: str) -> bool:
    """What Spark's file sources pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _found(folder: str, deep: bool) -> Iterator[tuple[str, int]]:
    """(path within the folder, length) of its files; a local folder is walked, so that no list of it is held."""
    files, top = opened(folder)
    if not isinstance(files, fs.LocalFileSystem):
        top = top.rstrip("/")
        for info in files.get_file_info(fs.FileSelector(top, recursive=deep)):
            inner = info.path[len(top) + 1 :]
            if info.type == fs.FileType.File and not any(map(_hidden, inner.split("/"))):
                yield inner, info.size
        return
    todo = [""]
    while todo:
        inside = todo.pop()
        with os.scandir(os.path.join(top, inside)) as entries:
            for entry in entries:
                if _hidden(entry.name):
                    continue
                if entry.is_dir():
                    todo += [os.path.join(inside, entry.name)] if deep else []
                else:
                    yield os.path.join(inside, entry.name), entry.stat().st_size


def listed(spark: SparkSession, paths: str | list[str], names: str = "*", deep: bool = True) -> DataFrame | None:
    """(path, length) of the files of folders that have bytes and a name that fits `names`, listed by tasks, one a folder.

    Spark's own file sources list files in the driver, which keeps about a kilobyte of each.  None where that is needed: for a path
    that is a pattern, no folder, or not opened by pyarrow, and for patterns of names with more than * and ?.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if re.search(r"[\[\]{}\\/]", names) or any(re.search(r"[*?\[\]{}\\,]", p) for p in paths):
        return None
    try:
        if any(f.get_file_info(p).type != fs.FileType.Directory for f, p in map(opened, paths)):
            return None
    except (OSError, pa.ArrowException):
        return None
    whole = [p if re.match("[a-z0-9+.-]+:", p) else "file:" + os.path.abspath(p) for p in paths]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda held: pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["path", "length"])
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                held = []
                for inner, length in _found(folder, deep):
                    if length and fnmatch.fnmatchcase(inner.rsplit("/", 1)[-1], names):
                        held.append((f"{folder.rstrip('/')}/{inner}", length))
                    if len(held) >= 10_000:
                        yield table(held)
                        held = []
                if held:
                    yield table(held)

    where = shared(spark, "listed")
    spark.createDataFrame([(p,) for p in dict.fromkeys(whole)], "folder string").repartition(len(set(whole))).mapInArrow(rows, "path string, length long").write.parquet(where)
    return spark.read.schema("path string, length long").parquet(where)


def contents(files: DataFrame) -> DataFrame:
    """(path, length, content) of listed files, dealt over tasks by their number and bytes."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    spark = files.sparkSession
    tasks = max(-(-(size + n * COST) // SHARE), min(n, spark.sparkContext.defaultParallelism), 1)
    most = 8 << 20

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            lengths = batch.column("length").to_pylist()
            while first < len(lengths):
                held, past, total = [], first, 0
                while past < len(lengths) and (not held or total + lengths[past] <= most):
                    files, path = opened(batch.column("path")[past].as_py())
                    with files.open_input_stream(path, compression=None) as data:
                        held.append(data.read())
                    total += len(held[-1])
                    past += 1
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(first, past - first), pa.array([len(c) for c in held], pa.int64()), pa.array(held, pa.binary())], ["path", "length", "content"])
                first = past

    return files.repartition(tasks, "path").mapInArrow(rows, "path string, length long, content binary")
