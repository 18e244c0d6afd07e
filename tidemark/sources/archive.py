"""The archive of raw interactions: appended by month, read by month, kept for a while.

Rows lie in ``month=yyyy_MM/run=...``. A run overwrites its own partitions only (dynamic overwrite), so a run that is
repeated after a failure leaves what one run leaves. Reading a month prunes to its folders, and
retention drops whole months without reading a row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import month_bounds

RETENTION_DAYS = 90


def append_run(rows: DataFrame, path: str, run: str, created: Column, body: Column) -> None:
    """Append a run's rows with the month of ``created`` and size_chars, the length of the body as JSON (null: none).

    Files are cut by Spark's size target (rebalance), so a hot month is many files and a small one is one.
    """
    sized = rows.withColumns({"size_chars": F.length(body), "month": F.coalesce(month_bounds(F.to_date(created))["suffix"], F.lit("undated")), "run": F.lit(run)})
    sized.hint("rebalance", "month").write.partitionBy("month", "run").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_archive(spark: SparkSession, path: str, *months: str) -> DataFrame:
    """The rows of the archive, or of some of its months (yyyy_MM): other folders aren't read."""
    rows = spark.read.option("basePath", path).option("inferSchema", "false").parquet(path)
    rows = rows.withColumns({"month": F.col("month").cast("string"), "run": F.col("run").cast("string")})
    return rows.where(F.col("month").isin(*months)) if months else rows


def drop_expired(spark: SparkSession, path: str, today: dt.date, days: int = RETENTION_DAYS) -> list[str]:
    """Delete the months that ended ``days`` or more before today; their names. Undated rows stay."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(root) if files.exists(root) else []:
        name = status.getPath().getName().removeprefix("month=")
        try:
            start = dt.datetime.strptime(name, "%Y_%m").date()
        except ValueError:
            continue
        end = (start.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        if end <= today - dt.timedelta(days=days):
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
