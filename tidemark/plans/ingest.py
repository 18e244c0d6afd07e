"""Ingestion queries: normalise, merge, versions, links, runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.records import first_of, goods_terms, int_list, parsed, source_id
from tidemark.functions.text import slug
from tidemark.operators.latest import latest
from tidemark.operators.merge import change_kind, merge, reconcile_links, snapshot_diff, versions
from tidemark.plans.base import query


@query(
    "normalize_records",
    """SELECT event_id, coalesce(CAST(props->>'$.sourceId' AS VARCHAR), 'EUIPO-' || lpad((props->>'$.k'), 6, '0')) AS source_id, (props->>'$.k')::INT AS k, CASE WHEN (props->>'$.k') IS NULL THEN [] ELSE [(props->>'$.k')::INT] END AS classes FROM events""",
)
def normalize_records(read):
    """Canonical fields of JSON records with alias keys."""
    v = parsed(F.col("props"))
    number = F.lpad(first_of(v, "applicationNumber", "application_number", "k"), 6, "0")
    return read("events").select("event_id", source_id(first_of(v, "source_id", "sourceId"), F.lit("EUIPO"), number).alias("source_id"), first_of(v, "k", kind="int").alias("k"), int_list(v, "k").alias("classes"))


_SQL_SNAP = "SELECT o_custkey AS id, max(o_orderstatus) AS status, max(o_orderpriority) AS priority, CAST(count(*) AS VARCHAR) AS filings FROM orders WHERE {w} GROUP BY o_custkey"
_SQL_MERGE = f"""WITH cur AS ({_SQL_SNAP.format(w="o_orderdate < TIMESTAMP '1998-01-01'")}), bat AS ({_SQL_SNAP.format(w="o_orderdate >= TIMESTAMP '1998-01-01'").replace("CAST(count(*) AS VARCHAR)", "CASE WHEN count(*) % 4 = 0 THEN '' ELSE CAST(count(*) AS VARCHAR) END")}),
j AS (SELECT coalesce(c.id, b.id) AS id, c.id IS NOT NULL AS inc, b.id IS NOT NULL AS inb, c.status AS s0, c.priority AS p0, c.filings AS f0,
    CASE WHEN length(b.status) > 0 THEN b.status ELSE c.status END AS status, CASE WHEN length(b.priority) > 0 THEN b.priority ELSE c.priority END AS priority, CASE WHEN length(b.filings) > 0 THEN b.filings ELSE c.filings END AS filings FROM cur c FULL JOIN bat b ON c.id = b.id),
o AS (SELECT *, CASE WHEN NOT inc THEN 'created' WHEN NOT inb THEN 'kept' WHEN status IS DISTINCT FROM s0 OR priority IS DISTINCT FROM p0 OR filings IS DISTINCT FROM f0 THEN 'updated' ELSE 'unchanged' END AS outcome,
    array_to_string(list_filter([CASE WHEN status IS DISTINCT FROM s0 THEN 'status' END, CASE WHEN priority IS DISTINCT FROM p0 THEN 'priority' END, CASE WHEN filings IS DISTINCT FROM f0 THEN 'filings' END], lambda x: x IS NOT NULL), ',') AS changed FROM j)"""


def _merged(read):
    orders = read("orders").select(F.col("o_custkey").alias("id"), "o_orderstatus", "o_orderpriority", "o_orderdate")
    snap = lambda rows, n: rows.groupBy("id").agg(F.max("o_orderstatus").alias("status"), F.max("o_orderpriority").alias("priority"), n.alias("filings"))
    count = F.count(F.lit(1))
    current = snap(orders.where("o_orderdate < timestamp'1998-01-01'"), count.cast("string"))
    batch = snap(orders.where("o_orderdate >= timestamp'1998-01-01'"), F.when(count % 4 == 0, "").otherwise(count.cast("string")))
    return merge(current, batch, "id", ["status", "priority", "filings"])


@query("merge_outcomes", f"{_SQL_MERGE} SELECT id, status, priority, filings, outcome, changed FROM o")
def merge_outcomes(read):
    """A batch merged into the current state, by outcome."""
    return _merged(read).withColumn("changed", F.array_join("changed", ","))


@query("merge_counters", f"{_SQL_MERGE} SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def merge_counters(read):
    """Counters of a batch."""
    return _merged(read).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "version_history",
    """WITH e AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, before, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS version_number, CASE WHEN before IS NULL THEN 'created' ELSE 'status_change' END AS change_type FROM e WHERE before IS DISTINCT FROM event_type""",
)
def version_history(read):
    """One version per change of state, numbered in order of arrival."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    states = read("events").withColumn("before", F.lag("event_type").over(order)).where(~F.col("before").eqNullSafe(F.col("event_type")))
    return versions(states, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "before", "event_type", "version_number", F.when(F.col("before").isNull(), "created").otherwise("status_change").alias("change_type"))


@query(
    "change_classification",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE o_orderstatus END AS a1, o_orderstatus AS b1, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS a2, o_orderpriority AS b2, CASE WHEN o_orderkey % 7 = 0 THEN '[]' ELSE '[9]' END AS a3, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '[9]' END AS b3 FROM orders),
d AS (SELECT o_orderkey, list_filter([CASE WHEN a1 IS DISTINCT FROM b1 THEN 'status' END], lambda x: x IS NOT NULL) AS changed,
    list_filter([CASE WHEN a3 = '[]' AND b3 = '[9]' THEN 'nice_classes' END, CASE WHEN a2 IS NULL AND b2 IS NOT NULL THEN 'renewal_status' END], lambda x: x IS NOT NULL) AS added, list_filter([CASE WHEN a3 = '[9]' AND b3 IS NULL THEN 'nice_classes' END], lambda x: x IS NOT NULL) AS removed,
    CASE WHEN a3 = '[]' AND b3 IS NULL THEN ['nice_classes'] ELSE [] END AS odd FROM s)
SELECT o_orderkey, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed, array_to_string(list_sort(list_concat(changed, odd)), ',') AS changed,
    CASE WHEN list_contains(changed, 'status') THEN 'status_change' WHEN list_contains(added, 'renewal_status') THEN 'renewal_update' WHEN list_contains(list_concat(added, removed, odd), 'nice_classes') THEN 'classification_change' ELSE 'update' END AS change_type FROM d""",
)
def change_classification(read):
    """The diff of two snapshots and its kind."""
    k = F.col("o_orderkey")
    old = F.create_map(F.lit("status"), F.when(k % 3 == 0, "O").otherwise(F.col("o_orderstatus")), F.lit("renewal_status"), F.when(k % 5 == 0, None).otherwise(F.col("o_orderpriority")), F.lit("nice_classes"), F.when(k % 7 == 0, "[]").otherwise("[9]"))
    new = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("renewal_status"), F.col("o_orderpriority"), F.lit("nice_classes"), F.when(k % 11 == 0, None).otherwise("[9]"))
    d = read("orders").select("o_orderkey", snapshot_diff(old, new).alias("d"))
    names = lambda part: F.map_keys(F.col("d")[part])
    touched = F.array_union(F.array_union(names("added"), names("removed")), names("changed"))
    joined = {p: F.array_join(F.array_sort(names(p)), ",") for p in ("added", "removed", "changed")}
    return d.select("o_orderkey", *[c.alias(p) for p, c in joined.items()], change_kind(touched).alias("change_type"))


@query(
    "party_upsert_latest",
    """WITH p AS (SELECT 'name:' || trim(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '-') || ':' || CAST(c_nationkey AS VARCHAR) AS party_key, c_name, o_orderdate, o_orderkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT party_key, c_name, o_orderpriority AS latest_value, o_orderkey AS latest_order FROM p QUALIFY row_number() OVER (PARTITION BY party_key ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def party_upsert_latest(read):
    """Parties by derived key, the latest values win."""
    joined = read("orders").join(read("customer"), F.col("c_custkey") == F.col("o_custkey"))
    keyed = joined.withColumn("party_key", F.substring(F.concat(F.lit("name:"), slug(F.col("c_name")), F.lit(":"), F.col("c_nationkey").cast("string")), 1, 64))
    return latest(keyed, ["party_key"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("party_key", "c_name", F.col("o_orderpriority").alias("latest_value"), F.col("o_orderkey").alias("latest_order"))


@query(
    "link_sync_fullouter",
    """WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL THEN 'keep' WHEN a.l_orderkey IS NULL THEN 'insert' ELSE 'delete' END AS action FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey) GROUP BY action""",
)
def link_sync(read):
    """Links to keep, insert and delete."""
    links = read("lineitem")
    keys = ["l_orderkey", "l_suppkey"]
    return reconcile_links(links.where("l_linenumber <= 3").select(*keys), links.where("l_linenumber >= 3").select(*keys), keys).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "goods_terms_zip",
    """WITH s AS (SELECT p_partkey, [p_size % 50 + 1, (p_size * 3) % 50 + 1] AS c, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_name, ' ', '; ') || ';' END AS t FROM part),
q AS (SELECT *, list_filter(list_transform(string_split(t, ';'), lambda x: trim(x)), lambda x: x <> '') AS ts FROM s)
SELECT DISTINCT p_partkey, u.c AS class_number, u.t AS term FROM (SELECT p_partkey, unnest(CASE WHEN len(c) = len(ts) THEN list_transform(range(1, 3), lambda i: {'c': c[i], 't': ts[i]}) ELSE list_transform(c, lambda x: {'c': x, 't': trim(t)}) END) AS u FROM q) WHERE u.c BETWEEN 1 AND 45""",
)
def goods_terms_zip(read):
    """Goods and services terms by class."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit(";")))
    classes = F.array(F.col("p_size") % 50 + 1, (F.col("p_size") * 3) % 50 + 1)
    return read("part").select("p_partkey", F.inline(goods_terms(classes, text)))


@query(
    "incremental_latest_wins",
    "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY ts, user_id",
)
def incremental_latest_wins(read):
    """The latest update of each number wins, in order of date."""
    return latest(read("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "ts", "event_id", "event_type").orderBy("ts", "user_id")


@query(
    "cursor_resolution",
    """WITH r AS (SELECT o_orderpriority AS source, max(o_orderdate) FILTER (o_orderstatus IN ('F', 'P')) AS cursor_value FROM orders GROUP BY 1)
SELECT source, coalesce(cursor_value - INTERVAL 1 HOUR, TIMESTAMP '2000-06-14 18:00:00') AS since FROM r""",
)
def cursor_resolution(read):
    """Where the next poll of each source starts."""
    usable = F.max(F.when(F.col("o_orderstatus").isin("F", "P"), F.col("o_orderdate").cast("timestamp")))
    return read("orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.coalesce(usable - F.expr("interval 1 hour"), F.lit("2000-06-14 18:00:00").cast("timestamp")).alias("since"))


@query(
    "sources_get_or_create",
    """WITH known AS (SELECT DISTINCT o_orderpriority AS name FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority < '3') SELECT name, true AS existing FROM known UNION ALL SELECT DISTINCT o_orderpriority, false FROM orders WHERE o_orderpriority NOT IN (SELECT name FROM known)""",
)
def sources_get_or_create(read):
    """Registered sources and those to create."""
    names = read("orders").select(F.col("o_orderpriority").alias("name"), "o_orderkey")
    known = names.where("o_orderkey % 2 = 0 and name < '3'").select("name").distinct()
    new = names.select("name").distinct().join(known, "name", "left_anti")
    return known.withColumn("existing", F.lit(True)).unionByName(new.withColumn("existing", F.lit(False)))


@query("document_dedup_sha256", "SELECT sha256(text) AS file_hash, source, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def document_dedup(read):
    """Archive by content hash and type; the first document of each stays."""
    return read("documents").groupBy(F.sha2("text", 256).alias("file_hash"), "source").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
