"""A stream of payload files, encoded as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import jobs

_FILES = "path string, modificationTime timestamp, length long, content binary"


def payload_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, content) of every file that comes into a folder."""
    files = spark.readStream.format("binaryFile").schema(_FILES).load(folder)
    return files.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def encode_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Encode what lies in and comes into `folder`, by any narrow method, to Parquet; ends when all present files are done."""
    encoded = jobs.encode_table(payload_stream(spark, folder), **options)
    return encoded.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
