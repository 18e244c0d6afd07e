"""Backfill by windows with a checkpoint: a run that was interrupted goes on with the windows that aren't finished."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AT_ONCE = 12
CHECKPOINT = "window_start date, window_end date, n_rows long, run string"


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoint: a row for each finished window."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/checkpoint")
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    rows = spark.read.schema(CHECKPOINT).parquet(f"{path}/checkpoint") if there else spark.createDataFrame([], CHECKPOINT)
    # A run that died after its rows and before its end may have noted a window twice.
    return rows.groupBy("window_start", "window_end").agg(F.min_by("n_rows", "run").alias("n_rows"), F.min("run").alias("run"))


def backfill(windows: DataFrame, fetch: Callable[[object, object], DataFrame], at: str, path: str, run: str, at_once: int = AT_ONCE, jobs: int | None = None) -> int:
    """Fetch the windows (window_start, window_end) that aren't finished yet, in order; how many were.

    ``fetch(start, end)`` gives the rows whose date ``at`` lies in [start, end). ``at_once`` windows are one job, written to
    their own partitions (a window that is fetched again overwrites itself) and then noted in the checkpoint. ``jobs``
    ends the run early.
    """
    spark = windows.sparkSession
    done = finished(spark, path).select(F.col("window_start").alias("_done"))
    left = windows.join(done, F.col("window_start") == F.col("_done"), "left_anti").orderBy("window_start").collect()  # calendar windows, not rows
    fetched = 0
    for job, first in enumerate(range(0, len(left), at_once)):
        if jobs is not None and job >= jobs:
            break
        part = left[first : first + at_once]
        asked = spark.createDataFrame([(w.window_start, w.window_end) for w in part], "window_start date, window_end date")
        rows = fetch(part[0].window_start, part[-1].window_end)
        day = F.to_date(F.col(at))
        inside = rows.join(F.broadcast(asked), (day >= F.col("window_start")) & (day < F.col("window_end"))).drop("window_end")
        inside.hint("rebalance", "window_start").write.partitionBy("window_start").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/rows")
        written = spark.read.schema(inside.schema).parquet(f"{path}/rows").groupBy(F.col("window_start").alias("_start")).agg(F.count(F.lit(1)).alias("n"))
        noted = asked.join(written, F.col("window_start") == F.col("_start"), "left").select("window_start", "window_end", F.coalesce("n", F.lit(0)).alias("n_rows"), F.lit(run).alias("run"))
        noted.coalesce(1).write.mode("append").parquet(f"{path}/checkpoint")
        fetched += len(part)
    return fetched
