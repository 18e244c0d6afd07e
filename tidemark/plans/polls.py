"""Paged source, repeated keys in a batch, snapshots, parties, timestamps and slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.dates import iso_timestamp
from tidemark.functions.records import TRACKED_FIELDS, named_parties, snapshot
from tidemark.functions.text import truncated
from tidemark.operators.merge import merge_in_order
from tidemark.plans.base import query
from tidemark.sources.envelopes import registered
from tidemark.sources.registry import detail, poll
from tidemark.sources.staging import shared_path

_PAGE = 50


def _pages(read):
    """Envelopes of 50 parts each, in the order of their keys."""
    record = F.struct(F.col("p_partkey").alias("applicationNumber"), F.col("p_name").alias("wordMark"))
    pages = read("part").groupBy(F.floor(F.col("p_partkey") / _PAGE).cast("int").alias("page")).agg(F.array_sort(F.collect_list(record)).alias("results"))
    total = read("part").agg(F.max(F.floor(F.col("p_partkey") / _PAGE)).cast("int") + 1).first()[0]
    return pages.select("page", F.to_json(F.struct("results", F.lit(total).alias("totalPages"), F.lit(_PAGE).alias("size"), "page")).alias("body"))


@query("paged_records", f"SELECT p_partkey // {_PAGE} AS page, p_partkey % {_PAGE} AS place, p_partkey AS number, p_name AS word_mark FROM part")
def paged_records(read):
    """All pages of a paged source, to the last of totalPages."""
    records, _ = poll(_pages(read), _PAGE, max_pages=1 << 30)
    v = F.parse_json("record")
    number, name = F.try_variant_get(v, "$.applicationNumber", "long"), F.try_variant_get(v, "$.wordMark", "string")
    return records.select("page", "place", number.alias("number"), name.alias("word_mark"))


_PER_FILE = 16


def _written(read) -> str:
    """The pages as an archive of envelopes in the shared folder, some pages a file."""
    pages = _pages(read).withColumn("file", F.floor(F.col("page") / _PER_FILE))
    path = shared_path(pages.sparkSession, "envelopes")
    pages.repartition("file").sortWithinPartitions("file", "page").select("file", "body").write.partitionBy("file").text(path)
    return path


_RECORDS = f"SELECT p_partkey // {_PAGE} AS page, p_partkey % {_PAGE} AS place, p_partkey::VARCHAR AS number, p_name AS word_mark FROM part"


def _opened(records):
    return records.select("page", "place", "number", F.try_variant_get(F.parse_json("record"), "$.wordMark", "string").alias("word_mark"))


@query("registry_records", f"{_RECORDS} WHERE p_partkey // {_PAGE} >= 2")
def registry_records(read):
    """The registry as a data source, read in parallel runs of pages; the first two pages aren't asked for."""
    path = _written(read)
    spark = registered(read("part").sparkSession)
    return _opened(spark.read.format("registry").option("size", _PAGE).option("pagesPerFile", _PER_FILE).load(path).where("page >= 2"))


@query("registry_stream", _RECORDS)
def registry_stream(read):
    """Polls of the data source as a stream with a cap, each a new run from the same checkpoint, until no page is left."""
    path = _written(read)
    spark = registered(read("part").sparkSession)
    pages = _pages(read).count()
    out, offsets, progress = (shared_path(spark, name) for name in ("registry-rows", "registry-offsets", "registry-progress"))
    for _ in range(3):
        stream = spark.readStream.format("registry").options(size=_PAGE, pagesPerFile=_PER_FILE, maxPages=-(-pages // 3), progress=f"{progress}/page.json").load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    return _opened(spark.read.schema(stream.schema).parquet(out))


@query(
    "poll_outcomes",
    f"""WITH n AS (SELECT max(p_partkey) // {_PAGE} + 1 AS pages FROM part), caps AS (SELECT unnest([1, 20, 1000000]) AS max_pages)
SELECT max_pages, least(pages, max_pages)::INT AS pages, pages <= max_pages AS complete, CASE WHEN pages > max_pages THEN max_pages END AS next_page FROM n, caps""",
)
def poll_outcomes(read):
    """Where polls with a cap of 1, of 20 and without one end, and where the next one starts."""
    pages = _pages(read)
    rows = [(cap, o["pages"], o["complete"], o["next_page"]) for cap in (1, 20, 1_000_000) for o in [poll(pages, _PAGE, cap)[1]]]
    return pages.sparkSession.createDataFrame(rows, "max_pages int, pages int, complete boolean, next_page int")


@query("record_details", "SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS number, p_name AS word_mark FROM lineitem JOIN part ON p_partkey = l_partkey")
def record_details(read):
    """The detail records of the numbers that are asked for."""
    records, _ = poll(_pages(read), _PAGE, max_pages=1 << 30)
    asked = read("lineitem").select(F.col("l_partkey").cast("string").alias("key"))
    found = detail(records, asked, "applicationNumber", "application_number")
    return found.select(F.col("key").alias("number"), F.try_variant_get(F.parse_json("record"), "$.wordMark", "string").alias("word_mark"))


_CURRENT = "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS priority FROM customer WHERE c_custkey % 3 <> 0"
_LAST = "last_value({f} IGNORE NULLS) OVER (PARTITION BY id ORDER BY turn, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "merge_repeated_keys",
    f"""WITH r AS (SELECT id, NULL::BIGINT AS o_orderkey, nullif(segment, '') AS segment, priority, 0 AS turn FROM ({_CURRENT}) UNION ALL
    SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderstatus END, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END, 1 FROM orders),
s AS (SELECT id, turn, o_orderkey, {_LAST.format(f='segment')} AS segment, {_LAST.format(f='priority')} AS priority, row_number() OVER (PARTITION BY id ORDER BY turn, o_orderkey) AS place FROM r),
p AS (SELECT *, lag(segment) OVER w AS s0, lag(priority) OVER w AS p0 FROM s WINDOW w AS (PARTITION BY id ORDER BY place)),
o AS (SELECT *, CASE WHEN place = 1 THEN 'created' WHEN segment IS DISTINCT FROM s0 OR priority IS DISTINCT FROM p0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM p),
v AS (SELECT *, sum(CASE WHEN turn = 1 AND outcome <> 'unchanged' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY place)::BIGINT AS version FROM o)
SELECT id, o_orderkey, segment, priority, outcome, version FROM v WHERE turn = 1""",
)
def merge_repeated_keys(read):
    """A batch in which keys repeat, merged row by row in order of arrival: every change is a version."""
    current = read("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("priority"))
    k = F.col("o_orderkey")
    segment = F.when(k % 4 == 0, "").when(k % 4 == 1, None).otherwise(F.col("o_orderstatus"))
    batch = read("orders").select(F.col("o_custkey").alias("id"), "o_orderkey", segment.alias("segment"), F.when(k % 5 == 0, None).otherwise(F.col("o_orderpriority")).alias("priority"))
    merged = merge_in_order(current, batch, "id", ["segment", "priority"], ["o_orderkey"])
    return merged.select("id", "o_orderkey", "segment", "priority", "outcome", "version")


@query(
    "mark_snapshots",
    """SELECT o_orderkey, json_object('source_id', 'EUIPO-' || o_orderkey, 'application_number', CAST(o_orderkey AS VARCHAR), 'application_date', strftime(o_orderdate, '%Y-%m-%d'), 'registration_number', NULL, 'registration_date', NULL,
    'word_mark', c_name, 'figurative_mark_url', NULL, 'status', o_orderstatus, 'renewal_status', o_orderpriority, 'nice_classes', json_array(o_custkey % 45 + 1), 'applicants', json_array(json_object('name', c_name)), 'representatives', json_array(), 'goods_services', c_mktsegment, 'jurisdiction', 'EUIPO')::VARCHAR AS snapshot
FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def mark_snapshots(read):
    """The tracked fields of a mark as JSON, dates in ISO form, nulls kept."""
    rows = read("orders").join(read("customer"), F.col("c_custkey") == F.col("o_custkey"))
    none = F.lit(None).cast("string")
    values = {
        "source_id": F.concat(F.lit("EUIPO-"), F.col("o_orderkey").cast("string")), "application_number": F.col("o_orderkey").cast("string"), "application_date": F.to_date("o_orderdate"),
        "registration_number": none, "registration_date": F.lit(None).cast("date"), "word_mark": F.col("c_name"), "figurative_mark_url": none, "status": F.col("o_orderstatus"), "renewal_status": F.col("o_orderpriority"),
        "nice_classes": F.array(F.col("o_custkey") % 45 + 1), "applicants": F.array(F.struct(F.col("c_name").alias("name"))), "representatives": F.array().cast("array<string>"), "goods_services": F.col("c_mktsegment"), "jurisdiction": F.lit("EUIPO"),
    }
    return rows.select("o_orderkey", snapshot({f: values[f] for f in TRACKED_FIELDS}).alias("snapshot"))


@query(
    "named_parties",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS first_name FROM orders",
)
def parties(read):
    """Of a mark's parties those with a name."""
    k = F.col("o_orderkey")
    party = lambda name: F.struct(name.alias("name"), F.lit("PT").alias("country"))
    listed = F.array(party(F.when(k % 2 == 0, F.col("o_orderpriority"))), party(F.lit("")), F.lit(None), party(F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise("")))
    return read("orders").select("o_orderkey", named_parties(listed).alias("p")).select("o_orderkey", F.size("p").alias("n"), F.get("p", F.lit(0))["name"].alias("first_name"))


@query("watch_items_of_lists", "SELECT l_orderkey, l_linenumber, o_custkey AS owner FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def watch_items(read):
    """Watched items with the owner of their list."""
    return read("lineitem").join(read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("owner"))


@query(
    "update_cursors",
    """WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s FROM events)
SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN epoch_us(CAST(s AS TIMESTAMP) - INTERVAL 2 HOUR) ELSE epoch_us(CAST(s AS TIMESTAMP)) END AS micros FROM t""",
)
def update_cursors(read):
    """ISO timestamps with Z, naive, with an offset, invalid and null."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    i = F.col("event_id") % 5
    given = F.when(i == 0, F.concat(text, F.lit("Z"))).when(i == 1, text).when(i == 2, F.concat(text, F.lit("+02:00"))).when(i == 3, "not a time")
    return read("events").select("event_id", F.unix_micros(iso_timestamp(given)).alias("micros"))


@query("truncated_texts", "SELECT doc_id, coalesce(text, '')[1:500] AS short FROM documents")
def truncated_texts(read):
    """The first 500 characters (the operator is the cut); null is empty."""
    return read("documents").select("doc_id", truncated(F.col("text"), 500).alias("short"))


@query("top_slices", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 5")
def top_slices(read):
    """The five best of each list; three of them are public."""
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read("orders").select("o_custkey", "o_orderkey", F.row_number().over(best).alias("place")).where("place <= 5")
