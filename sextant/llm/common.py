"""Helpers that the text operators share: the shared folder, written tables, row keys, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space of the word pattern ``[^\x20\x09-\x0D]+``, as a Java character class.
SPACE = r"[ \t\n\x0B\f\r]"
#: Largest written table, of a few numbers a row, that is sent to all executors.
BROADCAST_ROWS = 500_000
#: Links of a round that one task writes.
TASK_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master may do without one and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", base)
    return qualified(spark, base.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, as Spark reads it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file:///" + full[5:].lstrip("/") if full.startswith("file:") else full


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While a table is written: Spark deletes the job's shuffle files at its end and not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_OPEN: list[list[tuple[str, str]]] = []


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those whose tags are in ``keep``, on which the result rests."""
    mine: list[tuple[str, str]] = []
    _OPEN.append(mine)
    try:
        yield
    finally:
        _OPEN.pop()
        for tag, path in mine:
            if tag not in keep:
                _delete(spark, path)
            elif _OPEN:
                _OPEN[-1].append((tag, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    schema = df.schema
    with shuffles_dropped(spark):
        df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append((tag, path))
    return spark.read.schema(schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with the written table ``right``, which is sent to all executors only if it has ``BROADCAST_ROWS`` rows at most; else both are shuffled."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, key, how)


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows named by ``bad``: (doc_id, __key), the key being ``xxhash64(text)``; ``bad`` is written first, and sent to all only if it is small."""
    bad = materialize(bad.distinct().withColumnRenamed("doc_id", "__id"), "bad")
    small = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(small, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_anti")


def heap_released(spark: SparkSession) -> None:
    """Executors collect garbage and give free heap back to the system: what earlier stages filled is room for the Python workers of the next one. It changes no result."""
    n = spark.sparkContext.defaultParallelism  # a task for each core
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def row_key(*cols: str) -> Column:
    """64-bit key of a row's columns; null-safe, equal for repeated rows."""
    return F.xxhash64(*[F.col(c) for c in cols])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` holds links between long keys ``a`` and ``b``. Returns (node, label) for every node with a link to
    another node; the label is the smallest key of its component. Each round is two aggregations and two
    joins on the links, written to the shared folder; the number of rounds grows with the logarithm of the longest path. It ends when the links are stars:
    every node has one link down, to a node that has none.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark = e.sparkSession
    e = materialize(e, "links")
    tasks = 2 + e.count() // TASK_ROWS  # rounds make no more links than there are, whatever number of partitions the session shuffles to
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(small.union(low).distinct().coalesce(tasks), "links")
        for file in before.inputFiles()[:1]:
            _delete(spark, file.rsplit("/", 1)[0])
        if e.groupBy("u").count().where("count > 1").isEmpty() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    heads = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(heads)
