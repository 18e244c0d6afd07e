"""Priorities, the ladder of evidence and the checkpointed backfill against plain loops; odd rows, hot keys, interrupted runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.backfill import backfill, finished
from tidemark.operators.reconcile import conflict_rows, field_values, reconciled, resolved_fields


def test_fields_of_three_sources(spark):
    rng = random.Random(1)
    fields = ["a", "b", "c"]
    tables = {s: {k: [rng.choice([None, "x", "y", "z"]) for _ in fields] for k in range(40) if rng.random() < 0.8} for s in ("one", "two", "three")}
    ranks = [("a", "one", 1, "prefer"), ("a", "two", 2, "prefer"), ("b", "two", 1, "preserve_both"), ("b", "one", 2, "preserve_both"), ("b", "three", 3, "preserve_both")]
    frames = {s: spark.createDataFrame([(k, *v) for k, v in rows.items()], "id int, a string, b string, c string") for s, rows in tables.items()}
    resolved = resolved_fields(field_values(frames, "id", fields), "id", spark.createDataFrame(ranks, "field string, source string, rank int, policy string"))
    order = {(f, s): r for f, s, r, _ in ranks}
    want, conflicts = {}, set()
    for k in range(40):
        for n, f in enumerate(fields):
            found = sorted((order.get((f, s), 1 << 30), s, rows[k][n]) for s, rows in tables.items() if k in rows and rows[k][n] is not None)
            if found:
                differ = len({v for _, _, v in found}) > 1
                resolution = "agreed" if not differ else "review_required" if f == "b" else "resolved_by_priority"
                want[k, f] = (found[0][2], found[0][1], resolution)
                conflicts |= {(k, f, s, v, resolution) for _, s, v in found if v != found[0][2]}
    assert {(r.id, r.field): (r.value, r.source, r.resolution) for r in resolved.collect()} == want
    assert {(r.id, r.field, r.source, r.value, r.resolution) for r in conflict_rows(resolved, "id").collect()} == conflicts and len(conflicts) > 30


def grams(name):
    return {g for w in name.lower().split() for g in (lambda p: [p[i : i + 3] for i in range(len(p) - 2)])(f"  {w} ")}


def test_every_event_takes_the_strongest_rung_once(spark):
    rng = random.Random(2)
    words = ["golden", "harbour", "silver", "garden", "north", "river", "stone"]
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    marks = [(k, f"{rng.choice(words)} {rng.choice(words)}", day(k % 5), rng.choice(["x", "y", None])) for k in range(60)] + [(None, "golden stone", day(1), "x"), (7, None, day(2), "y")]
    typo = lambda n: n if rng.random() < 0.4 else n[:2] + n[3:]
    events = [(rng.choice([None, None, k, 999]), typo(n), day(rng.randrange(9)), rng.choice(["x", "y", "z", None]), e) for e, (k, n, _, _) in enumerate([m for m in marks if m[0] is not None and m[1]] * 3)]
    events += [(None, None, None, None, 1000), (None, "", day(1), "x", 1001)] + [(None, "goldn harbour", day(8), "x", 2000 + k) for k in range(300)]
    schema = "number int, name string, date date, block string"
    got = reconciled(spark.createDataFrame(events, f"{schema}, event int"), spark.createDataFrame(marks, schema), 0.5).collect()
    want = {}
    for number, name, date, block, event in events:
        if number is not None and any(m[0] == number for m in marks):
            want[event] = ("strong", number)
        elif same := [m[0] for m in marks if m[0] is not None and name is not None and m[1] == name and m[2] == date]:
            want[event] = ("medium", min(same))
        else:
            near = {}
            for n, text, _, b in marks:
                if None not in (name, text, b) and b == block and (grams(name) | grams(text)):
                    score = len(grams(name) & grams(text)) / len(grams(name) | grams(text))
                    if score >= 0.5:
                        near.setdefault((-score, text), []).append(n)
            best = min(near, default=None)
            ids = [n for n in near.get(best, []) if n is not None]
            want[event] = ("weak", min(ids)) if ids else ("none", None)
    assert len(got) == len(events) and {r.event: (r.strength, r.mark) for r in got} == want
    assert {s for s, _ in want.values()} == {"strong", "medium", "weak", "none"}


def test_backfill_goes_on_where_it_was_interrupted(spark, tmp_path):
    months = [dt.date(2023 + k // 12, k % 12 + 1, 1) for k in range(19)]
    windows = spark.createDataFrame(list(zip(months, months[1:], strict=False)), "window_start date, window_end date")
    rows = spark.range(600).select(F.col("id"), F.date_add(F.lit(dt.date(2023, 1, 1)), F.col("id").cast("int")).alias("day"))
    path, asked = str(tmp_path / "b"), []

    def fetch(start, end, dies=None):
        asked.append((start, end))
        if dies == start:
            raise RuntimeError("gone")
        return rows.where((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))

    with pytest.raises(RuntimeError):
        backfill(windows, lambda a, b: fetch(a, b, months[8]), "day", path, "first", at_once=4)
    assert finished(spark, path).count() == 8
    # A run that wrote its rows and died before it noted them.
    late = rows.where("id < 300").withColumn("window_start", F.trunc("day", "month")).where(F.col("window_start") == F.lit(months[8]))
    late.write.partitionBy("window_start").mode("append").parquet(f"{path}/rows")
    assert backfill(windows, fetch, "day", path, "second", at_once=4) == 10
    assert asked[:3] == [(months[0], months[4]), (months[4], months[8]), (months[8], months[12])] and asked[3:] == [(months[8], months[12]), (months[12], months[16]), (months[16], months[18])]
    assert backfill(windows, fetch, "day", path, "third", at_once=4) == 0 and len(asked) == 6
    end = (months[18] - dt.date(2023, 1, 1)).days
    assert sorted(r.id for r in spark.read.parquet(f"{path}/rows").select("id").collect()) == list(range(end))
    assert {(r.window_start, r.run) for r in finished(spark, path).collect()} == {(m, "first" if k < 8 else "second") for k, m in enumerate(months[:-1])}


def test_events_without_a_key_are_dealt_over_all_tasks(spark):
    """Rows without a number, and those that need no weak evidence, have nulls in the keys of the joins."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        marks = spark.createDataFrame([(1, "golden stone", dt.date(2024, 1, 1), "x"), (2, "north river", dt.date(2024, 1, 1), "x")], "number int, name string, date date, block string")
        numbered = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 1).alias("number"), F.when(F.col("id") % 4 > 0, "golden stone").alias("name"), F.lit(dt.date(2024, 1, 1)).alias("date"), F.lit("x").alias("block"), "id")
        got = reconciled(numbered, marks)
        # A count that used no column of the last join would be planned without it.
        counts = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("strength").alias("n"), F.max("score")).collect()]
        assert sum(counts) == 2000 and len(counts) == 4 and max(counts) < 800
        assert {(r.strength, r.mark): r["count"] for r in got.groupBy("strength", "mark").count().collect()} == {("strong", 1): 1000, ("medium", 1): 1000}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
