"""Shared helpers: tables staged in the cluster's shared folder, word rules, reading inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
CHECKPOINT = "spark.checkpoint.dir"
#: Spark's setting to delete a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limit to the bytes that go to a Python worker at a time.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a new local one only on a local master where it is unset."""
    context = spark.sparkContext
    found = spark.conf.get(CHECKPOINT, None) or context.getConf().get(CHECKPOINT) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT} must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
        found = context.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for the jobs that run inside."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: lost executors cost no recomputation of what came before, later readers scan
    columns, and the planner knows the true size when it decides on a broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    # The written table takes the place of the query's shuffles, whose files go when the write ends.
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A plain alias may be inlined by the optimizer into every use, inside a lambda even once per
    element; a lambda variable is computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, lengthened until they clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, for a plan that has more."""
    return [F.col(f"`{c}`") for c in df.columns]


def in_ranges(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, str, str]:
    """Stage ``df`` sorted by ``order`` over ranges; the names of its two new columns: range and place in it (from 0).

    Equal rows are told apart by nothing, so ``order`` should be total where a key may be hot.
    """
    where, part, place = free_names(df, "pos", "range", "place")
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(where, F.monotonically_increasing_id())
    staged = stage_table(sorted_, name)
    return staged.withColumn(part, F.shiftright(where, 33)).withColumn(place, F.col(where).bitwiseAND(F.lit((1 << 33) - 1))).drop(where), part, place


def running_sums(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``df`` with ``<column>_before`` for each of ``sums``: its sum over all rows before, in ``order``.

    No task sorts all rows: rows are range-partitioned, a range is summed by a window, and the ranges'
    totals (one row a range) give each range its start.
    """
    placed, part, place = in_ranges(df, order, name)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    total = placed.groupBy(part).agg(*[F.sum(c).alias(c) for c in sums])
    starts = total.select(F.col(part).alias(f"{part}_"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_start") for c in sums])
    within = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    inside = [(F.col(f"{c}_start") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before") for c in sums]
    return placed.join(starts, F.col(part) == F.col(f"{part}_")).select(*own_columns(df), *inside)
