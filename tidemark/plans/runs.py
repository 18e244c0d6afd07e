"""Run logs, request checks and the notification catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.runs import closed_runs, notification, recipient, request_problems
from tidemark.plans.base import query


@query(
    "run_log",
    """WITH r AS (SELECT o_orderpriority AS source, min(o_orderdate) AS started_at, max(o_orderdate) AS finished_at, count(*) AS processed, count(*) FILTER (o_orderstatus = 'P') AS failed, repeat('x', 2500) AS error, max(o_orderkey)::VARCHAR AS cursor_value FROM orders GROUP BY 1)
SELECT source, CASE WHEN failed = 0 THEN 'completed' WHEN failed = processed THEN 'failed' ELSE 'partial' END AS status, CAST(epoch(finished_at) - epoch(started_at) AS BIGINT) AS seconds, length(error[1:2000]) AS error_chars, cursor_value FROM r""",
)
def run_log(read):
    """Closed runs with their status and duration."""
    key = F.col("o_orderkey")
    runs = read("orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("finished_at"), F.count(F.lit(1)).alias("processed"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"), F.max(key).cast("string").alias("cursor_value"))
    done = closed_runs(runs.withColumn("error", F.repeat(F.lit("x"), 2500)))
    return done.select("source", "status", "seconds", F.length("error").cast("long").alias("error_chars"), "cursor_value")


@query(
    "request_validation",
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN trim(m) = '' THEN 'blank_mark' END, CASE WHEN length(trim(m)) > 255 THEN 'long_mark' END, CASE WHEN p_size % 50 + 1 > 45 THEN 'bad_class' END], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN p_name ELSE repeat(p_name, 40) END AS m FROM part)""",
)
def request_validation(read):
    """P25: problems of requests."""
    k = F.col("p_partkey")
    mark = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.col("p_name")).otherwise(F.repeat("p_name", 40))
    return read("part").select("p_partkey", F.array_join(request_problems(mark, F.array((F.col("p_size") % 50 + 1).cast("int"))), ",").alias("problems"))


@query(
    "notification_catalogue",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'trademark.similar_filing' WHEN 'click' THEN 'trademark.deadline' END AS event, event_id % 4 <> 1 AND event_id % 3 <> 0 AS valid, lower(trim('  User' || user_id || '@X.org ')) AS recipient FROM events""",
)
def notification_catalogue(read):
    """The event of an alert, its payload's validity, the normalised recipient."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "similar_filing").when(F.col("event_type") == "click", "deadline").otherwise("other")
    payload = F.create_map(F.when(i % 3 == 0, "name").otherwise("mark"), F.lit("x"), F.when(i % 4 == 1, "Token").otherwise("due"), F.lit("y"))
    n = notification(kind, payload)
    return read("events").select("event_id", n["event"].alias("event"), n["valid"].alias("valid"), recipient(F.concat(F.lit("  User"), F.col("user_id").cast("string"), F.lit("@X.org "))).alias("recipient"))
