"""Monthly archive: idempotent runs, pruned months, retention."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.sources.archive import append_run, drop_expired, read_archive


def rows(spark, days, body="{}"):
    return spark.createDataFrame([(k, None if d is None else dt.date.fromisoformat(d), body) for k, d in enumerate(days)], "id int, day date, body string")


def add(df, path, run):
    append_run(df, path, run, F.col("day"), F.col("body"))


def test_append_read_and_drop(spark, tmp_path):
    path = str(tmp_path / "raw")
    add(rows(spark, ["1999-11-30", "1999-12-01", "1999-12-31", "2000-01-01", None]), path, "a")
    add(rows(spark, ["1999-12-15", "2000-02-29"], None), path, "b")
    add(rows(spark, ["1999-12-16", "2000-02-29"], '{"x":1}'), path, "b")  # the run again, with other rows
    every = read_archive(spark, path).collect()
    assert sorted((r.month, r.run, r.size_chars) for r in every) == [
        ("1999_11", "a", 2), ("1999_12", "a", 2), ("1999_12", "a", 2), ("1999_12", "b", 7), ("2000_01", "a", 2), ("2000_02", "b", 7), ("undated", "a", 2)]
    month = read_archive(spark, path, "1999_12")
    assert {r.day.isoformat() for r in month.collect()} == {"1999-12-01", "1999-12-16", "1999-12-31"}
    plan = month._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "month" in filters and "1999_12" in filters and len(month.inputFiles()) < len(read_archive(spark, path).inputFiles()) + 1
    assert drop_expired(spark, path, dt.date(2000, 3, 31)) == ["1999_11", "1999_12"]  # December ended 90 days before
    assert drop_expired(spark, path, dt.date(2000, 3, 31)) == []
    assert sorted({r.month for r in read_archive(spark, path).collect()}) == ["2000_01", "2000_02", "undated"]
    assert drop_expired(spark, str(tmp_path / "none"), dt.date(2000, 3, 31)) == []


def test_a_hot_month_is_many_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(200_000).select(F.col("id"), F.when(F.col("id") % 50 == 0, F.lit("2001-02-03")).otherwise("2001-01-05").cast("date").alias("day"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
        add(df, str(tmp_path / "raw"), "a")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in read_archive(spark, str(tmp_path / "raw")).inputFiles()]
    assert sum("2001_01" in f for f in files) > 3
