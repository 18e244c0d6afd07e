"""Queries of the documented bulletin contract: discovery, archive, classification, reconciliation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import fold
from tidemark.operators.graph import revision_graph
from tidemark.operators.latest import latest
from tidemark.plans.base import query, sql_fold
from tidemark.sources.archive import append_run, drop_expired, read_archive
from tidemark.sources.staging import shared_path


@query("url_discovery", "SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS n_links, coalesce(list_min(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)), '') AS first_link FROM pages")
def url_discovery(read):
    """Links of a listing page, without repeats."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    return read("pages").select("page_id", F.size(found).alias("n_links"), F.coalesce(F.array_min(found), F.lit("")).alias("first_link"))


@query("backfill_windows", "SELECT CAST(d AS DATE) AS window_start, CAST(d + INTERVAL 1 MONTH AS DATE) AS window_end FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS d)")
def backfill_windows(read):
    """Monthly windows from the first month to the last date."""
    last = read("orders").agg(F.to_date(F.max("o_orderdate")).alias("last"))
    return last.select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.col("last"), F.expr("interval 1 month"))).alias("window_start")).select("window_start", F.add_months("window_start", 1).alias("window_end"))


@query(
    "archive_versions",
    """WITH f AS (SELECT source, sha256(coalesce(text, '')) AS h, min(doc_id) AS seen FROM documents GROUP BY ALL) SELECT source, h, seen, row_number() OVER (PARTITION BY source ORDER BY seen, h)::INT AS version FROM f""",
)
def archive_versions(read):
    """Z3: another content under the same name is another version, in order of arrival."""
    first = read("documents").groupBy("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.min("doc_id").alias("seen"))
    return first.withColumn("version", F.row_number().over(Window.partitionBy("source").orderBy("seen", "h")))


@query("ocr_trigger", "SELECT doc_id FROM documents WHERE length(text) < 400 AND doc_id % 3 > 0 AND source LIKE 'src1%'")
def ocr_trigger(read):
    """Short pages with images in a section are sent to OCR."""
    return read("documents").where((F.length("text") < 400) & (F.col("doc_id") % 3 > 0) & F.col("source").startswith("src1")).select("doc_id")


@query(
    "section_segmentation",
    """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN 'S' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""",
)
def section_segmentation(read):
    """The last heading before each line."""
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("event_type") == "signup", F.concat(F.lit("S"), F.col("event_id").cast("string")))
    return read("events").select("user_id", "event_id", F.last(heading, ignorenulls=True).over(so_far).alias("section"))


@query("taxonomy_aliases", f"SELECT doc_id, max(CASE WHEN contains({sql_fold('text')}, 'licensed under') OR contains({sql_fold('text')}, 'released under') THEN 'license' WHEN contains({sql_fold('text')}, 'cion') THEN 'spanish' ELSE 'other' END) AS kind FROM documents GROUP BY doc_id")
def taxonomy_aliases(read):
    """Classification by aliases, accents and case aside."""
    t = fold(F.col("text"))
    kind = F.when(t.contains("licensed under") | t.contains("released under"), "license").when(t.contains("cion"), "spanish").otherwise("other")
    return read("documents").groupBy("doc_id").agg(F.max(kind).alias("kind"))


@query("canonical_values", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, regexp_replace('Proc. ' || o_custkey || ' / ' || o_orderkey, '[^0-9]+', '', 'g') AS digits FROM orders")
def canonical_values(read):
    """Dates and numbers in one form."""
    dotted = F.date_format("o_orderdate", "yyyy.MM.dd")
    number = F.concat(F.lit("Proc. "), F.col("o_custkey").cast("string"), F.lit(" / "), F.col("o_orderkey").cast("string"))
    return read("orders").select("o_orderkey", F.replace(dotted, F.lit("."), F.lit("-")).alias("day"), F.regexp_replace(number, "[^0-9]+", "").alias("digits"))


@query("semantic_keys", "SELECT sha256(concat_ws('|', o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CAST(o_custkey AS VARCHAR), coalesce(o_orderpriority, ''))) AS dedupe_key, count(*) AS n FROM orders GROUP BY 1")
def semantic_keys(read):
    """Keys of the parts that make an event the same."""
    key = F.sha2(F.concat_ws("|", "o_orderstatus", F.to_date("o_orderdate").cast("string"), F.col("o_custkey").cast("string"), F.coalesce("o_orderpriority", F.lit(""))), 256)
    return read("orders").groupBy(key.alias("dedupe_key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "reprocessing_matrix",
    """WITH a AS (SELECT o_orderkey, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'conflict' WHEN a.v = b.v THEN 'no_op' ELSE 'supersede' END AS fate, count(*) AS n FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey GROUP BY 1""",
)
def reprocessing_matrix(read):
    """What a second run means for each event."""
    k = F.col("o_orderkey")
    a = read("orders").where(k % 3 != 0).select("o_orderkey", F.col("o_orderpriority").alias("old"), F.lit(True).alias("ina"))
    b = read("orders").where(k % 5 != 0).select("o_orderkey", F.when(k % 4 == 0, "x").otherwise(F.col("o_orderpriority")).alias("new"), F.lit(True).alias("inb"))
    fate = F.when(F.col("ina").isNull(), "new").when(F.col("inb").isNull(), "conflict").when(F.col("old") == F.col("new"), "no_op").otherwise("supersede")
    return a.join(b, "o_orderkey", "full").groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "reconciliation_ladder",
    """WITH strong AS (SELECT o_orderkey AS k, max(o_custkey) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), medium AS (SELECT o_custkey AS k, max(o_orderkey) AS m FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)
SELECT CASE WHEN s.m IS NOT NULL THEN 'strong' WHEN d.m IS NOT NULL THEN 'medium' ELSE 'none' END AS strength, count(*) AS n, sum(coalesce(s.m, d.m, 0))::BIGINT AS checksum FROM lineitem l LEFT JOIN strong s ON s.k = l.l_orderkey LEFT JOIN medium d ON d.k = l.l_partkey GROUP BY 1""",
)
def reconciliation_ladder(read):
    """The strongest match of each event."""
    orders = read("orders")
    strong = orders.where("o_orderkey % 2 = 0").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.max("o_custkey").alias("s"))
    medium = orders.where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("l_partkey")).agg(F.max("o_orderkey").alias("d"))
    strength = F.when(F.col("s").isNotNull(), "strong").when(F.col("d").isNotNull(), "medium").otherwise("none")
    return read("lineitem").join(strong, "l_orderkey", "left").join(medium, "l_partkey", "left").groupBy(strength.alias("strength")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("s", "d", F.lit(0))).alias("checksum"))


@query(
    "field_conflicts",
    """WITH r AS (SELECT o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
p AS (SELECT a.o_custkey, unnest([{'f': 'status', 'a': a.o_orderstatus, 'b': b.o_orderstatus}, {'f': 'priority', 'a': a.o_orderpriority, 'b': b.o_orderpriority}]) AS u FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.r = 1 AND b.r = 2)
SELECT o_custkey, u.f AS field, u.a AS chosen, u.b AS other FROM p WHERE u.a <> u.b""",
)
def field_conflicts(read):
    """Fields on which two sources differ; the one of higher priority is chosen."""
    ranked = read("orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    a = ranked.where("r = 1").select("o_custkey", F.struct("o_orderstatus", "o_orderpriority").alias("a"))
    b = ranked.where("r = 2").select("o_custkey", F.struct("o_orderstatus", "o_orderpriority").alias("b"))
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col("a")[c].alias("chosen"), F.col("b")[c].alias("other")) for n, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))])
    return a.join(b, "o_custkey").select("o_custkey", F.inline(fields)).where("chosen <> other")


@query(
    "component_confidence",
    "SELECT doc_id, round(s, 6) AS score, CASE WHEN s >= 0.85 THEN 'accept' WHEN s >= 0.65 THEN 'review' ELSE 'reject' END AS route FROM (SELECT doc_id, (n_chars > 500)::INT * 0.4::DOUBLE + (lang = 'en')::INT * 0.3::DOUBLE + (source <> 'src0')::INT * 0.3::DOUBLE AS s FROM documents)",
)
def component_confidence(read):
    """Weighted components and their thresholds."""
    part = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    s = part(F.col("n_chars") > 500, 0.4) + part(F.col("lang") == "en", 0.3) + part(F.col("source") != "src0", 0.3)
    return read("documents").select("doc_id", F.round(s, 6).alias("score"), F.when(s >= 0.85, "accept").when(s >= 0.65, "review").otherwise("reject").alias("route"))


@query("required_fields", "SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL OR (event_type = 'purchase' AND value < 5) OR props IS NULL) AS invalid FROM events GROUP BY 1")
def required_fields(read):
    """Events that lack what their type requires."""
    bad = F.col("value").isNull() | ((F.col("event_type") == "purchase") & (F.col("value") < 5)) | F.col("props").isNull()
    return read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("invalid"))


@query("raw_retention", "SELECT date_trunc('month', ts)::DATE AS month, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY GROUP BY 1")
def raw_retention(read):
    """Rows inside of the retention period, by partition."""
    return read("events").where(F.col("ts") >= F.expr("timestamp_ntz'2024-01-31 00:00:00' - interval 20 days")).groupBy(F.trunc(F.to_date("ts"), "month").alias("month")).agg(F.count(F.lit(1)).alias("kept"))


_ARCHIVED = "strftime(o_orderdate, '%Y_%m') AS month, 'run-' || (o_orderkey % 2 + 1) AS run, length('{\"status\":\"' || o_orderstatus || '\"}')::INT AS size_chars"
_AS_OF = dt.date(2001, 3, 20)


def _archive(read) -> str:
    """Two runs append their half of the orders, the second one twice."""
    orders = read("orders")
    path = shared_path(orders.sparkSession, "raw")
    for half in (1, 2, 2):
        mine = orders.where(F.col("o_orderkey") % 2 + 1 == half).select("o_orderkey", "o_orderdate", F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("body"))
        append_run(mine, path, f"run-{half}", F.col("o_orderdate"), F.col("body"))
    return path


@query("raw_archive_month", f"SELECT o_orderkey, {_ARCHIVED} FROM orders WHERE o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def raw_archive_month(read):
    """K1, K2: interactions appended by month, idempotently, and one month read back from its own partitions."""
    return read_archive(read("orders").sparkSession, _archive(read), "1997_12").select("o_orderkey", "month", "run", "size_chars")


@query("raw_archive_retained", f"SELECT o_orderkey, {_ARCHIVED} FROM orders WHERE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH > TIMESTAMP '{_AS_OF}' - INTERVAL 90 DAY")
def raw_archive_retained(read):
    """What is left after the months that ended 90 days ago or more are dropped."""
    spark, path = read("orders").sparkSession, _archive(read)
    drop_expired(spark, path, _AS_OF)
    return read_archive(spark, path).select("o_orderkey", "month", "run", "size_chars")


_PARENT = "CASE WHEN c_custkey % 50 = 1 THEN NULL WHEN c_custkey % 100 IN (10, 20, 70) THEN c_custkey + 1 WHEN c_custkey % 100 IN (11, 21, 71) THEN c_custkey - 1 ELSE c_custkey - 1 - c_custkey % 3 END"


@query(
    "revision_graph",
    f"""WITH RECURSIVE p AS (SELECT c_custkey AS v, {_PARENT} AS up FROM customer), links AS (SELECT v, up FROM p WHERE up IN (SELECT v FROM p)),
reach AS (SELECT v, up AS x FROM links UNION SELECT r.v, l.up FROM reach r JOIN links l ON r.x = l.v),
loops AS (SELECT v AS on_cycle FROM reach WHERE v = x),
ends AS (SELECT p.v, count(r.x) AS steps, max(r.x) FILTER (r.x NOT IN (SELECT v FROM links)) AS root, min(r.x) FILTER (r.x IN (SELECT on_cycle FROM loops)) AS cycle FROM p LEFT JOIN reach r ON r.v = p.v GROUP BY p.v),
kids AS (SELECT up, count(*) AS n FROM links GROUP BY up)
SELECT e.v AS revision, CASE WHEN cycle IS NULL THEN coalesce(root, e.v) END AS root, CASE WHEN cycle IS NULL THEN steps END AS depth, cycle, e.v IN (SELECT on_cycle FROM loops) AS in_cycle,
    coalesce(n, 0) AS n_children, n IS NULL AS is_head FROM ends e LEFT JOIN kids ON kids.up = e.v""",
)
def revision_graph_of_customers(read):
    """Root, depth, children and cycles of every revision of a chain of parent pointers."""
    return revision_graph(read("customer").select(F.col("c_custkey").alias("revision"), F.expr(_PARENT).alias("parent")))


@query(
    "revision_heads",
    "SELECT c_custkey AS revision FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey <> c.c_custkey AND (d.c_custkey * 7) % 1000 + 1 = c.c_custkey)",
)
def revision_heads(read):
    """Revisions that no other one has as its parent."""
    c = read("customer").select(F.col("c_custkey").alias("revision"))
    parents = c.select(((F.col("revision") * 7) % 1000 + 1).alias("parent"), F.col("revision").alias("child")).where("parent <> child")
    return c.join(parents, F.col("revision") == F.col("parent"), "left_anti")


@query(
    "schema_drift",
    "SELECT column_name, CASE WHEN a AND b THEN 'both' WHEN a THEN 'removed' ELSE 'added' END AS fate FROM (SELECT coalesce(x.n, y.n) AS column_name, x.n IS NOT NULL AS a, y.n IS NOT NULL AS b FROM (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_tokens']) AS n) x FULL JOIN (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS n) y ON x.n = y.n)",
)
def schema_drift(read):
    """U2, 2.15: declared columns against those of a table, both ways."""
    from pyspark.sql import SparkSession

    table = read("documents")
    spark = SparkSession.active()
    names = lambda xs: spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in xs])).alias("column_name"))
    a, b = names(["doc_id", "text", "lang", "source", "n_tokens"]).withColumn("a", F.lit(True)), names(table.columns).withColumn("b", F.lit(True))
    return a.join(b, "column_name", "full").select("column_name", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "removed").otherwise("added").alias("fate"))


@query("latest_by_source", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def latest_by_source(read):
    """W1 over documents: the longest document of each source."""
    return latest(read("documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id")
