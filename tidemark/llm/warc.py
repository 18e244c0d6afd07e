"""WARC archives with a Merkle fixity audit.

Records are WARC/1.1 responses whose fields come from a page. They are written to archives of
``ARCHIVE_RECORDS`` records in the order of their ids; each record has its slot in the archive, its byte
offset and its length. The digests of ``FANOUT`` consecutive slots make a range, ranges make a node, and so
on to one root an archive. A node covers its children's slots, digests and byte lengths, so a damaged record
changes the nodes above it and no others. An audit compares two replicas' roots, then the children of
mismatching nodes only, down to records; every level is staged once.

Slots are those of the writer and don't depend on content. If an archive's record ids differ between
replicas (a record is missing or added, and the rest has moved up), that archive's records are first aligned
by id, so that no other record counts as damaged.

A record's number is its rank by (page_id, url, row), counted over ranges: neither a hot host nor an id
with a third of all rows outgrows a task or an archive, and equal rows are spread by their row number.

Records carry the fields that WARC/1.1 demands: a date, given by the writer, and an id that is a UUID of the record's archive and
slot, so records of one page are told apart. Bytes of a URL that a URI can't hold are percent-encoded.

Nulls: a null or empty url is ``about:blank``, a null html counts as empty; a null page_id is ordered first. Rows that repeat a page_id are
records of their own, told apart by their order. Empty replicas have no archive and audit clean.
Very long pages are hashed whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_ranges, read_table, running_sums, stage_table

FANOUT = 16
LEVELS = 4
ARCHIVE_RECORDS = 2_000
#: When the pages were fetched, if the writer isn't told.
DATE = "2026-01-01T00:00:00Z"
#: A character that a URI may hold.
URI = r"[\x21\x23-\x3B\x3D\x3F-\x5B\x5D\x5F\x61-\x7A\x7E]"


def target_uri(url: Column) -> Column:
    """The URL with every byte that a URI can't hold percent-encoded."""
    escaped = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(URI), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("about:blank")).when(url.rlike(f"^{URI}+$"), url).otherwise(F.array_join(escaped, ""))


def warc_record(record_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """The bytes of a WARC/1.1 response record; ``record_id`` names it among all records."""
    body = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce(html, F.lit(""))), "UTF-8")
    uuid = F.regexp_replace(F.md5(record_id), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target_uri(url),
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archives(pages: DataFrame, size: int = ARCHIVE_RECORDS, date: str = DATE) -> DataFrame:
    """Written archives: archive, slot, key (page_id) and record (bytes). The pages are shuffled once, into their order."""
    rows = pages.select(F.col("page_id").alias("key"), F.coalesce("url", F.lit("")).alias("url"), F.monotonically_increasing_id().alias("row"), "html")
    placed, part, place = in_ranges(rows, [F.col("key"), F.col("url"), F.col("row")], "warc-records")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col(part).alias("_range"), F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    starts = stage_table(starts, "warc-starts")  # one row a range
    number = F.col("start") + F.col(place)
    slots = placed.join(starts, F.col(part) == F.col("_range")).select(F.floor(number / size).alias("archive"), (number % size).cast("int").alias("slot"), "key", "url", "html")
    record = warc_record(F.concat_ws("/", F.col("archive").cast("string"), F.col("slot").cast("string")), F.col("url"), F.col("html"), date)
    return slots.select("archive", "slot", "key", record.alias("record"))


def digests(archived: DataFrame) -> DataFrame:
    """Staged: archive, slot, key, offset, length, digest of each record; the replica's index."""
    earlier = Window.partitionBy("archive").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    hashed = archived.select("archive", "slot", "key", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    return stage_table(hashed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))), "warc-digests")


def numbered(index: DataFrame) -> DataFrame:
    """The index with ``copy``: how many records of the same key come before."""
    ordered = running_sums(index.withColumn("one", F.lit(1)), [F.col("key"), F.col("archive"), F.col("slot")], ["one"], "warc-order")
    ordered = stage_table(ordered, "warc-numbers")
    first = ordered.groupBy(F.col("key").alias("_first")).agg(F.min("one_before").alias("start"))
    return ordered.join(first, F.col("key").eqNullSafe(F.col("_first"))).select(*index.columns, (F.col("one_before") - F.col("start")).alias("copy"))


def aligned(index_a: DataFrame, index_b: DataFrame) -> DataFrame:
    """The second index with the first one's slots, in the archives whose record ids differ.

    A record that the first replica lacks gets an archive number of its own (below zero).
    """
    ids = lambda index, name: index.groupBy("archive").agg(F.sum(F.xxhash64("slot", "key").cast("decimal(38,0)")).alias(name))
    moved = ids(index_a, "a").join(ids(index_b, "b"), "archive", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    moved = stage_table(moved.select(F.col("archive").alias("_moved")), "warc-moved")
    if moved.isEmpty():
        return index_b
    of = lambda index, how: index.join(moved, F.col("archive") == F.col("_moved"), how)
    known = numbered(of(index_a, "left_semi")).select(F.col("key").alias("_key"), F.col("copy").alias("_copy"), F.col("archive").alias("_archive"), F.col("slot").alias("_slot"))
    found = numbered(of(index_b, "left_semi")).join(known, F.col("key").eqNullSafe(F.col("_key")) & (F.col("copy") == F.col("_copy")), "left")
    placed = found.withColumns({"archive": F.coalesce("_archive", -1 - F.col("archive")), "slot": F.coalesce("_slot", "slot")}).select(*index_b.columns)
    return stage_table(of(index_b, "left_anti").unionByName(placed), "warc-aligned")


def _parent(level: int) -> Column:
    """The slot of a node's parent, from the level below the parents on."""
    return F.floor(F.col("slot") / FANOUT).cast("int") if level < LEVELS - 1 else F.lit(0)


def tree_levels(index: DataFrame) -> list[DataFrame]:
    """Staged nodes (archive, slot, length, digest) from the records up to one root an archive."""
    levels = [index.select("archive", "slot", "length", "digest")]
    for k in range(LEVELS):
        children = F.sort_array(F.collect_list(F.struct("slot", "digest", "length")))
        up = levels[k].groupBy("archive", _parent(k).alias("slot")).agg(F.sum("length").alias("length"), children.alias("c"))
        covered = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["slot"].cast("string"), x["digest"], x["length"].cast("string"))), ",")
        levels.append(stage_table(up.select("archive", "slot", "length", F.sha2(covered, 256).alias("digest")), f"warc-level-{k + 1}"))
    return levels


def damaged(index_a: DataFrame, index_b: DataFrame) -> DataFrame:
    """(archive, slot) of the records that differ, found by descending from mismatching roots."""
    a, b = tree_levels(index_a), tree_levels(index_b)
    wrong = None
    for k in range(LEVELS, -1, -1):
        left = a[k].select("archive", "slot", F.col("digest").alias("da"))
        right = b[k].select("archive", "slot", F.col("digest").alias("db"))
        if wrong is not None:
            # Only the children of mismatching nodes are looked at.
            keep = wrong.withColumnsRenamed({"archive": "_archive", "slot": "_up"})
            left, right = (x.join(keep, (F.col("archive") == F.col("_archive")) & (_parent(k) == F.col("_up")), "left_semi") for x in (left, right))
        wrong = stage_table(left.join(right, ["archive", "slot"], "full").where(~F.col("da").eqNullSafe(F.col("db"))).select("archive", "slot"), "warc-wrong")
    return wrong


def audit(replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """key, archive, slot, offset, length, digest (of the first replica) and corrupt of every record.

    corrupt: the second replica's record differs or is missing. Records that only the second replica has come
    last, corrupt, with archive below zero and null offset, length and digest.
    """
    index_a = digests(replica_a)
    index_b = aligned(index_a, digests(replica_b))
    wrong = damaged(index_a, index_b).withColumn("corrupt", F.lit(True)).withColumnsRenamed({"archive": "_archive", "slot": "_slot"})
    columns = ["key", "archive", "slot", "offset", "length", "digest"]
    none = [F.lit(None).cast(index_a.schema[c].dataType).alias(c) for c in columns[3:]]
    added = index_b.where("archive < 0").select(*columns[:3], *none, F.lit(True).alias("corrupt"))
    both = index_a.join(wrong, (F.col("archive") == F.col("_archive")) & (F.col("slot") == F.col("_slot")), "left")
    return both.select(*columns, F.coalesce("corrupt", F.lit(False)).alias("corrupt")).unionByName(added)


def decayed(archived: DataFrame, every: int) -> DataFrame:
    """A replica on which about one record of ``every``, chosen by a hash of its key, has a byte of its end changed."""
    hit = F.conv(F.substring(F.md5(F.col("key").cast("string")), 1, 8), 16, 10).cast("long") % every == 0
    n = F.octet_length("record")
    return archived.withColumn("record", F.when(hit, F.concat(F.col("record").substr(F.lit(1), n - 5), F.encode(F.lit("#"), "UTF-8"), F.col("record").substr(n - 3, F.lit(4)))).otherwise(F.col("record")))


def op3_warc(spark: SparkSession, folder: str, every: int = 97) -> DataFrame:
    """Audit of the pages' archives against a replica with a changed byte in about one record of 97."""
    made = archives(read_table(spark, folder, "pages").select("page_id", "url", "html"))
    return audit(made, decayed(made, every)).select(F.col("key").alias("page_id"), "length", "digest", "corrupt")


SQL = rf"""
WITH bodies AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER (ORDER BY page_id NULLS FIRST, coalesce(url, '')) - 1 AS n,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS body FROM pages),
made AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:uuid:' || regexp_replace(md5((n // {ARCHIVE_RECORDS}) || '/' || (n % {ARCHIVE_RECORDS})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\1-\2-\3-\4-') || '>' || chr(13) || chr(10)
    || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || CASE WHEN url = '' THEN 'about:blank'
        ELSE array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_matches(c, '{URI}') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') END || chr(13) || chr(10)
    || 'WARC-Block-Digest: sha256:' || sha256(body) || chr(13) || chr(10) || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM bodies)
SELECT page_id, strlen(record)::BIGINT AS length, sha256(record) AS digest, coalesce(('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 97 = 0, false) AS corrupt FROM made"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": SQL}
