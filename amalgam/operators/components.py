"""Connected components of an edge table, by min-label hooking and pointer jumping; tables in the shared folder."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folders that this process has made below the shared one.
_made: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where none is set, a local master gets a temporary one, deleted at exit; a cluster,
    whose machines share no temporary folder, an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="amalgam-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_base(spark)}/amalgam-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete every table that this process has put into the shared folder. Results that were not yet collected or written need them."""
    for path in list(_made):
        delete(spark, path)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: With the first, Spark deletes an execution's shuffle files when it ends; the second keeps Arrow batches of long texts small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH_ROWS: "1000"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; after it, all are as they were."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _cut(df: DataFrame, path: str, **more: str) -> DataFrame:
    """df written to path and read from there; the shuffle files behind it go at once, as the table stands for them."""
    with settings(df.sparkSession, WRITING | more):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str = "table", batch_rows: int = 1000) -> DataFrame:
    """df as a table in the shared folder. What is built on it plans by itself, nothing below it runs twice, and a lost executor loses nothing."""
    return _cut(df, scratch(df.sparkSession, tag), **{BATCH_ROWS: str(batch_rows)})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node of edges; component is the smallest node reachable.

    Each round takes every node's smallest label among its neighbours and then the
    label of its label, so long chains halve. Rounds are written to the shared folder:
    lineage stays short and a lost executor costs no earlier round. Work is linear in
    the edges each round; no pairs within a component are made. Null ends and
    self-loops only name their nodes. An empty edge table gives no rows.
    """
    spark = edges.sparkSession
    folder = scratch(spark, "components")
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    links = _cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/links")
    # the first round needs no join: each node's label is its smallest neighbour
    at = f"{folder}/0"
    labels = _cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), at)
    turn = 0
    while True:
        turn += 1
        near = links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = _cut(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")), f"{folder}/hooked-{turn}")
        if hooked.where("label <> old").isEmpty():
            delete(spark, f"{folder}/hooked-{turn}")
            break
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = _cut(hooked.join(up, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")), f"{folder}/{turn}")
        # nothing reads the tables of the round before any more
        delete(spark, at)
        delete(spark, f"{folder}/hooked-{turn}")
        at, labels = f"{folder}/{turn}", jumped
    delete(spark, f"{folder}/links")
    return labels.select("node", F.col("label").alias("component"))
