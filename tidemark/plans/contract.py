"""Queries of the bulletin contract that need a mechanism of their own: priorities, ladder, checkpointed backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.backfill import backfill, finished
from tidemark.operators.reconcile import conflict_rows, field_values, reconciled, resolved_fields
from tidemark.plans.base import SQL_MARK, mark_name, query, sql_jaccard, sql_trigrams
from tidemark.sources.staging import shared_path

_PRIORITIES = [
    ("publication_date", "bpi", 1, "prefer"), ("publication_date", "euipo", 2, "prefer"), ("status", "euipo", 1, "prefer"), ("status", "core", 2, "prefer"), ("status", "bpi", 3, "prefer"),
    ("holder", "euipo", 1, "preserve_both"), ("holder", "core", 2, "preserve_both"),
]
_FIELDS = ["publication_date", "status", "holder"]
_SQL_FIELDS = f"""values_ AS (
    SELECT l_orderkey AS k, 'bpi' AS source, unnest([{{'f': 'publication_date', 'v': CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR)}}, {{'f': 'status', 'v': max(l_linestatus)}}]) AS u FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT o_orderkey, 'euipo', unnest([{{'f': 'publication_date', 'v': CASE WHEN o_orderkey % 7 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END}}, {{'f': 'status', 'v': CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END}}, {{'f': 'holder', 'v': o_custkey::VARCHAR}}]) FROM orders
    UNION ALL SELECT o_orderkey, 'core', unnest([{{'f': 'publication_date', 'v': CAST(CAST(o_orderdate AS DATE) + (o_orderkey % 4)::INT AS VARCHAR)}}, {{'f': 'status', 'v': o_orderstatus}}, {{'f': 'holder', 'v': CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey + 1)::VARCHAR ELSE o_custkey::VARCHAR END}}]) FROM orders),
priorities AS (SELECT * FROM (VALUES {', '.join(map(str, _PRIORITIES))}) AS t(f, source, rank, policy)),
ranked AS (SELECT k, u.f AS f, u.v AS v, x.source, coalesce(p.rank, 1 << 30) AS rank FROM values_ x LEFT JOIN priorities p ON p.f = x.u.f AND p.source = x.source WHERE u.v IS NOT NULL),
chosen AS (SELECT k, f, arg_min(v, (rank, source, v)) AS value, arg_min(source, (rank, source, v)) AS source, count(DISTINCT v)::INT AS n_values FROM ranked GROUP BY k, f),
resolved AS (SELECT c.*, CASE WHEN n_values = 1 THEN 'agreed' WHEN policy = 'preserve_both' THEN 'review_required' ELSE 'resolved_by_priority' END AS resolution FROM chosen c LEFT JOIN (SELECT f, max(policy) AS policy FROM priorities GROUP BY f) USING (f))"""


def _resolved(read):
    orders = read("orders")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    bulletin = read("lineitem").groupBy(F.col("l_orderkey").alias("record")).agg(F.to_date(F.min("l_shipdate")).alias("publication_date"), F.max("l_linestatus").alias("status")).withColumn("holder", F.lit(None).cast("string"))
    registry = orders.select(k.alias("record"), F.when(k % 7 > 0, day).alias("publication_date"), F.when(k % 5 > 0, F.col("o_orderstatus")).alias("status"), F.col("o_custkey").alias("holder"))
    core = orders.select(k.alias("record"), F.date_add(day, (k % 4).cast("int")).alias("publication_date"), F.col("o_orderstatus").alias("status"), F.when(k % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("holder"))
    priorities = orders.sparkSession.createDataFrame(_PRIORITIES, "field string, source string, rank int, policy string")
    return resolved_fields(field_values({"bpi": bulletin, "euipo": registry, "core": core}, "record", _FIELDS), "record", priorities)


@query("field_priorities", f"WITH {_SQL_FIELDS} SELECT k AS record, f AS field, value, source, n_values, resolution FROM resolved")
def field_priorities(read):
    """Of three sources the value that a table of priorities per field prefers."""
    return _resolved(read).select("record", "field", "value", "source", "n_values", "resolution")


@query(
    "field_conflict_rows",
    f"""WITH {_SQL_FIELDS} SELECT DISTINCT r.k AS record, r.f AS field, r.value AS chosen, r.source AS chosen_source, x.source, x.v AS value, resolution FROM resolved r JOIN ranked x ON x.k = r.k AND x.f = r.f AND x.v <> r.value""",
)
def field_conflicts_of_three(read):
    """Every value that differs from the chosen one, with what becomes of it."""
    return conflict_rows(_resolved(read), "record")


_SQL_LADDER = f"""marks AS (SELECT p_partkey AS number, lower({SQL_MARK}) AS name, CAST(DATE '1995-01-01' + (p_partkey % 2000)::INT AS DATE) AS date, p_brand || '/' || p_size AS block FROM part),
events_ AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN l_partkey END AS number, CASE WHEN l_orderkey % 5 = 0 THEN left(name, 1) || substr(name, 3) WHEN l_orderkey % 11 = 0 THEN 'unheard of' ELSE name END AS name,
    CAST(date + (3 * (l_orderkey % 2))::INT AS DATE) AS date, block FROM lineitem JOIN marks ON number = l_partkey),
rungs AS (SELECT e.*, s.number AS strong, m.number AS medium FROM events_ e LEFT JOIN marks s ON s.number = e.number LEFT JOIN (SELECT name, date, min(number) AS number FROM marks GROUP BY ALL) m ON m.name = e.name AND m.date = e.date),
grams AS (SELECT name, {sql_trigrams('name')} AS g FROM (SELECT name FROM marks UNION SELECT name FROM events_)),
asked AS (SELECT DISTINCT block, r.name, g FROM rungs r JOIN grams USING (name) WHERE strong IS NULL AND medium IS NULL),
known AS (SELECT block, m.name, min(number) AS number, any_value(g) AS g FROM marks m JOIN grams USING (name) GROUP BY ALL),
weak AS (SELECT a.block, a.name, k.number, {sql_jaccard('a.g', 'k.g')} AS score FROM asked a JOIN known k ON a.block = k.block WHERE {sql_jaccard('a.g', 'k.g')} >= 0.6
    QUALIFY row_number() OVER (PARTITION BY a.block, a.name ORDER BY score DESC, k.name) = 1)"""


@query(
    "reconciled_events",
    f"""WITH {_SQL_LADDER} SELECT l_orderkey, l_linenumber, CASE WHEN strong IS NOT NULL THEN 'strong' WHEN medium IS NOT NULL THEN 'medium' WHEN w.number IS NOT NULL THEN 'weak' ELSE 'none' END AS strength,
    coalesce(strong, medium, w.number) AS mark, round(CASE WHEN coalesce(strong, medium) IS NOT NULL THEN 1 ELSE w.score END, 6) AS score
FROM rungs r LEFT JOIN weak w ON strong IS NULL AND medium IS NULL AND w.block = r.block AND w.name = r.name""",
)
def reconciled_events(read):
    """The strongest evidence of each event: number, name and date, a like name in the block, or none."""
    marks = read("part").select(F.col("p_partkey").alias("number"), F.lower(mark_name()).alias("name"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 2000).cast("int")).alias("date"), F.concat_ws("/", "p_brand", "p_size").alias("block"))
    k, name = F.col("l_orderkey"), F.col("name")
    printed = F.when(k % 5 == 0, F.concat(F.left(name, F.lit(1)), F.substring(name, 3, 1 << 30))).when(k % 11 == 0, "unheard of").otherwise(name)
    lines = read("lineitem").join(marks.withColumnRenamed("number", "l_number"), F.col("l_partkey") == F.col("l_number"))
    events = lines.select("l_orderkey", "l_linenumber", F.when(k % 3 == 0, F.col("l_partkey")).alias("number"), printed.alias("name"), F.date_add("date", (3 * (k % 2)).cast("int")).alias("date"), "block")
    return reconciled(events, marks).select("l_orderkey", "l_linenumber", "strength", "mark", F.round("score", 6).alias("score"))


_SQL_WINDOWS = "SELECT CAST(d AS DATE) AS window_start, CAST(d + INTERVAL 1 MONTH AS DATE) AS window_end, row_number() OVER (ORDER BY d) AS i FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS d)"


@query(
    "backfill_checkpoint",
    f"""WITH w AS ({_SQL_WINDOWS}) SELECT window_start, window_end, count(o_orderkey) AS n_rows, CASE WHEN i <= 40 THEN 'first' ELSE 'second' END AS run
FROM w LEFT JOIN orders ON o_orderdate >= window_start AND o_orderdate < window_end GROUP BY window_start, window_end, i""",
)
def backfill_checkpoint(read):
    """Monthly windows fetched by a run that is interrupted after 40 of them and by one that goes on."""
    orders = read("orders")
    path = shared_path(orders.sparkSession, "backfill")
    last = orders.agg(F.to_date(F.max("o_orderdate")).alias("last"))
    start = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.col("last"), F.expr("interval 1 month")))
    windows = last.select(start.alias("window_start")).select("window_start", F.add_months("window_start", 1).alias("window_end"))
    fetch = lambda a, b: orders.where((F.col("o_orderdate") >= F.lit(a)) & (F.col("o_orderdate") < F.lit(b)))
    backfill(windows, fetch, "o_orderdate", path, "first", at_once=40, jobs=1)
    backfill(windows, fetch, "o_orderdate", path, "second", at_once=40)
    return finished(orders.sparkSession, path)
