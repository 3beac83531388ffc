"""One file for each row, under the row's name: a writer that leaves a folder complete or as it was.

Tasks write into folders of their own attempts.  When all tasks are done, the folders of those that count are marked, and a
second job moves their files to their names, which can be repeated; if a task fails for good, what all have written is removed.
Any file system that pyarrow opens by URI will do, if driver and executors see it alike.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Where a folder holds what is not complete.
STAGING = "_staging"
#: Names that are broadcast; more are joined by a shuffle.
BROADCAST_NAMES = 200_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class _Written(WriterCommitMessage):
    attempt: str


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> _Written:
        files, top = _opened(self.folder)
        attempt = uuid.uuid4().hex
        for i, row in enumerate(iterator):
            if not i:
                files.create_dir(f"{top}/attempt-{attempt}", recursive=True)
            with files.open_output_stream(f"{top}/attempt-{attempt}/{row['name']}") as out:
                out.write(row["content"])
        return _Written(attempt)

    def commit(self, messages: list[_Written | None]) -> None:
        files, top = _opened(self.folder)
        for m in messages:  # one a task
            if m is not None and files.get_file_info(f"{top}/attempt-{m.attempt}").type != fs.FileType.NotFound:
                files.move(f"{top}/attempt-{m.attempt}", f"{top}/done-{m.attempt}")

    def abort(self, messages: list[_Written | None]) -> None:
        files, top = _opened(self.folder)
        if files.get_file_info(top).type != fs.FileType.NotFound:
            files.delete_dir(top)


class NamedFiles(DataSource):
    """The sink `named_files`: rows (name STRING, content BINARY) into a staging folder, by attempts of tasks."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def _published(folder: str):
    """(attempt) to (name): files moved to their names; one that is there already has been moved by an earlier try."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _opened(folder)
        for batch in batches:
            for attempt in batch.column("attempt").to_pylist():
                listed = [f.base_name for f in files.get_file_info(fs.FileSelector(attempt))]
                for name in listed:
                    files.move(f"{attempt}/{name}", f"{top}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array(listed, pa.string())], ["name"])

    return rows


def error(name: Column, content: Column) -> Column:
    """Why a row can't be a file; null where it can."""
    return F.when(name.isNull() | name.rlike(r"\A[ \t]*\z") | name.isin(".", "..", STAGING), "no file name").when(name.rlike("[/\\\\\\x00]"), "a name with a folder").when(content.isNull(), "no content")


def write(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's content to folder/name, and return (name, n_bytes LONG, error) of all rows.

    Rows that `error` tells of, and all rows of a name that several have (letters of either case count as one, as some file
    systems have it), are not written and carry an error.  Files of those names that lie in the folder are replaced; other
    files stay.  If the job fails, the folder is as it was, or, once all contents are written, has some of the new files, and
    the same call can be repeated.
    """
    spark = df.sparkSession
    rows = df.select(F.col(name).alias("name"), F.col(content).alias("content")).withColumn("error", error(F.col("name"), F.col("content")))
    twice = rows.where("error is null").groupBy(F.lower("name").alias("_name")).agg(F.count("*").alias("_n")).where("_n > 1").select("_name")
    side = F.broadcast(twice) if twice.count() <= BROADCAST_NAMES else twice
    rows = rows.join(side, F.lower("name") == side["_name"], "left").withColumn("error", F.coalesce("error", F.when(F.col("_name").isNotNull(), "several rows have the name"))).drop("_name")
    staging = f"{folder.rstrip('/')}/{STAGING}/{uuid.uuid4().hex}"
    stage(rows.where("error is null").select("name", "content"), staging)
    publish(spark, folder, staging)
    return rows.select("name", F.length("content").cast("long").alias("n_bytes"), "error")


def stage(rows: DataFrame, staging: str) -> None:
    """Write rows (name, content) to a staging folder; nothing stays there if that fails."""
    rows.sparkSession.dataSource.register(NamedFiles)
    try:
        rows.write.format("named_files").mode("append").save(staging)
    except Exception:
        time.sleep(1)  # tasks that ran on while the job was given up may have written once more
        _Writer(staging).abort([])
        raise


def publish(spark: SparkSession, folder: str, staging: str) -> None:
    """Move the files of a staging folder's complete attempts to their names, and remove it."""
    files, top = _opened(staging)
    done = [f.path for f in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.base_name.startswith("done-")]  # one a task
    if done:
        moved = spark.createDataFrame([(d,) for d in done], "attempt string").repartition(min(len(done), spark.sparkContext.defaultParallelism))
        moved.mapInArrow(_published(folder), "name string").write.format("noop").mode("overwrite").save()
    if files.get_file_info(top).type != fs.FileType.NotFound:
        files.delete_dir(top)
