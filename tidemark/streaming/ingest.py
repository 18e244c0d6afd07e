"""Incremental ingestion: each micro-batch is reduced to the latest row per key and merged idempotently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.latest import latest
from tidemark.operators.merge import merge
from tidemark.sources.staging import drop_staged, shared_path, staged


def stream_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if _single(spark, folder, table):
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{table}.parquet")


def _single(spark: SparkSession, folder: str, table: str) -> bool:
    """Whether a table is one file rather than a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process all that is there with ``each(batch, id)`` and stop; with a checkpoint, what is there since the last run."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint or shared_path(stream.sparkSession, "offsets"))
    writer.trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """The rows of a stream that has read all there is: those it appended, or its last complete result.

    With a ``path`` rows and offsets are kept there, and a later call goes on from them.
    """
    spark = stream.sparkSession
    checkpoint = f"{path}/offsets" if path else None
    path = f"{path}/rows" if path else shared_path(spark, "stream")
    schema = stream.schema
    part = (lambda n: 0) if mode == "complete" else (lambda n: n)
    run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={part(n)}"), mode, checkpoint)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


#: Buckets of a merged state; a batch writes those anew that it has keys of.
BUCKETS = 32


def merge_stream(stream: DataFrame, key: str, fields: list[str], order: list[str], path: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(state, outcomes) after the stream: the merged fields of each key and the outcome counts of each batch.

    ``order`` is among the fields: a row that isn't newer than its key's state changes nothing. State, outcomes and offsets
    lie under ``path``; a later call with the same path goes on from there. The state is cut into buckets by
    key, a batch reads and writes those of its own keys, as a version of its own number. A version counts once it is
    whole, and a batch that runs again starts from the versions before it, so it gives the same state and counts.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark, "merge")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    schema = stream.select(bucket, key, *fields).schema

    def each(batch: DataFrame, n: int) -> None:
        newest = staged(latest(batch, [key], [F.desc(c) for c in order]).select(bucket, key, *fields), "newest")
        touched = [r[0] for r in newest.select("bucket").distinct().collect()]
        current = _state(spark, path, schema, n, touched)
        known = current.select(F.col(key).alias("_key"), F.struct(*order).alias("_order"))
        newer = newest.join(known, F.col(key) == F.col("_key"), "left").where(F.col("_order").isNull() | (F.struct(*order) > F.col("_order")))
        merged = staged(merge(current.select(key, *fields), newer.select(key, *fields), key, fields), "merged")
        merged.where(F.col(key).isNotNull()).select(bucket, key, *fields).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/version={n}")
        merged.groupBy("outcome").count().withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/outcomes/run={n}")
        drop_staged(newest)
        drop_staged(merged)

    run_available(stream, each, checkpoint=f"{path}/offsets")
    return _state(spark, path, schema, 1 << 60).select(key, *fields), spark.read.schema("outcome string, count long, batch int").parquet(f"{path}/outcomes/run=*")


def _state(spark: SparkSession, path: str, schema, before: int, wanted: list[int] | None = None) -> DataFrame:
    """The rows of each (wanted) bucket's last whole version below ``before``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    last: dict[int, tuple[int, str]] = {}
    for version in files.listStatus(root) if files.exists(root) else []:
        folder, n = version.getPath(), int(version.getPath().getName().removeprefix("version="))
        if n < before and files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            for part in files.listStatus(folder):
                if (name := part.getPath().getName()).startswith("bucket="):
                    k = int(name.removeprefix("bucket="))
                    last[k] = max(last.get(k, (-1, "")), (n, part.getPath().toString()))
    paths = [p for k, (_, p) in last.items() if wanted is None or k in wanted]
    columns = [f for f in schema.fields if f.name != "bucket"]
    return spark.read.schema(StructType(columns)).parquet(*paths) if paths else spark.createDataFrame([], StructType(columns))


def once_in_overlap(stream: DataFrame, keys: list[str], time: str, overlap: str = "1 day", slack: str = "1 day") -> DataFrame:
    """Rows of overlapping polls, each once: the first of those with equal keys.

    A poll asks again for the last ``overlap``, from the start of a day on, so repeats come no later than overlap and slack
    after the newest time. State older than that goes with the watermark, which drops rows older still.
    """
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", f"{overlap} {slack}")
    return timed.dropDuplicatesWithinWatermark(keys).drop("_at")
