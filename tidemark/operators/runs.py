"""Run tracking and request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ERROR, MOST_CURSOR, MOST_MARK = 2000, 128, 255


def closed_runs(runs: DataFrame) -> DataFrame:
    """Finished run rows from (source, started_at, finished_at, processed, failed, error, cursor_value).

    completed if nothing failed, failed if nothing was processed, else partial; long texts are cut.
    """
    status = F.when(F.col("failed") == 0, "completed").when(F.col("processed") == F.col("failed"), "failed").otherwise("partial")
    seconds = F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return runs.withColumns({"status": status, "seconds": seconds, "error": F.substring("error", 1, MOST_ERROR), "cursor_value": F.substring("cursor_value", 1, MOST_CURSOR)})


def request_problems(mark: Column, classes: Column) -> Column:
    """What is wrong with an assessment request: array of blank_mark, long_mark, bad_class."""
    name = F.trim(F.coalesce(mark, F.lit("")))
    bad = F.exists(F.coalesce(classes, F.array().cast("array<int>")), lambda c: ~c.between(1, 45))
    return F.array_compact(F.array(F.when(name == "", "blank_mark"), F.when(F.length(name) > MOST_MARK, "long_mark"), F.when(bad, "bad_class")))


# Alert types and the notification events they become.
NOTIFICATIONS = {"similar_filing": "trademark.similar_filing", "deadline": "trademark.deadline", "renewal": "trademark.renewal", "opposition": "trademark.opposition", "status_change": "trademark.status_change"}
FORBIDDEN_KEYS = ("password", "token", "secret")


def notification(alert_type: Column, payload: Column) -> Column:
    """Struct of the notification event (null: none) and whether the payload map is complete and has no forbidden key."""
    table = F.create_map(*[F.lit(x) for kv in NOTIFICATIONS.items() for x in kv])
    keys = F.map_keys(payload)
    clean = ~F.exists(keys, lambda k: F.lower(k).isin(*FORBIDDEN_KEYS))
    return F.struct(F.try_element_at(table, alert_type).alias("event"), (clean & F.array_contains(keys, "mark")).alias("valid"))


def recipient(address: Column) -> Column:
    return F.lower(F.trim(address))
