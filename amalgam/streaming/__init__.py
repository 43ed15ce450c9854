"""Streams: new files as they arrive, through the same extractors.

The batch operators work on any DataFrame of files, so a stream of files needs only a
source and, because identity is resolved over all records, a table of records that
grows by batches.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import consolidate, extract
from ..sources.detect import with_types
from ..sources.files import with_content

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, raw) of the files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).load(folder)
    return files.selectExpr("path", "content AS raw")


def collect_records(files: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the records of each batch of files to a Parquet table, each batch once: a batch that is repeated replaces itself."""

    def append(batch: DataFrame, number: int) -> None:
        extract(with_types(with_content(batch))).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_profiles(spark: SparkSession, table: str) -> DataFrame:
    """The profiles of all records so far."""
    return consolidate(spark.read.parquet(table).drop("batch"))
