"""Damaged, missing, added and repeated records against a comparison of the records themselves."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc


@pytest.fixture(scope="module")
def good(spark):
    # Ids 1 to 40; id 7 six times with unlike texts, id 9 three times with equal ones, a null id.
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 5 + 1)) for i in range(1, 41)]
    rows += [(7, "http://h/7", f"other {k}") for k in range(5)] + [(9, "http://h/9", "page 9 " * 5)] * 2 + [(None, None, None)]
    return spark.createDataFrame(warc.archives(spark.createDataFrame(rows, "page_id long, url string, html string"), 10).collect())


def found(a, b):
    """(key, number among the records of that key in its replica) of the corrupt records."""
    count, out = {}, []
    for r in sorted(warc.audit(a, b).collect(), key=lambda r: (r.archive < 0, r.archive, r.slot)):
        count[r.key] = count.get(r.key, -1) + 1
        if r.corrupt:
            out.append((r.key, count[r.key]))
    return sorted(out, key=str)


def by_number(replica):
    count, out = {}, {}
    for r in sorted(replica.collect(), key=lambda r: (r.archive, r.slot)):
        count[r.key] = count.get(r.key, -1) + 1
        out[r.key, count[r.key]] = bytes(r.record)
    return out


def brute(a, b):
    one, two = by_number(a), by_number(b)
    return sorted((k for k in one.keys() | two.keys() if one.get(k) != two.get(k)), key=str)


def test_read_back_from_archives(good):
    rows = warc.audit(good, good).collect()
    assert len(rows) == good.count() == 48 and {r.archive for r in rows} == set(range(5))
    files, made = {}, {}
    for r in sorted(good.collect(), key=lambda r: (r.archive, r.slot)):
        files[r.archive] = files.get(r.archive, b"") + bytes(r.record)
        made[r.archive, r.slot] = bytes(r.record)
    for r in rows:
        assert files[r.archive][r.offset : r.offset + r.length] == made[r.archive, r.slot]


@pytest.mark.parametrize("hit", ["key = 7 and slot = 8", "key is null or key in (1, 20, 40)"])
def test_changed_records(good, hit):
    """A shorter and a longer record; records of one id are told apart."""
    new = F.when(F.expr("slot % 2 = 0"), F.encode(F.lit("gone"), "UTF-8")).otherwise(F.concat("record", F.encode(F.lit("#" * 3000), "UTF-8")))
    bad = good.withColumn("record", F.when(F.expr(f"coalesce({hit}, false)"), new).otherwise(F.col("record")))
    assert found(good, bad) == brute(good, bad) != []


def rewritten(spark, frame):
    """The replica as a writer would have written it with the records that are left: later slots have moved up."""
    rows = sorted(frame.collect(), key=lambda r: (r.archive, r.slot))
    return spark.createDataFrame([(k // 10, k % 10, r.key, r.record) for k, r in enumerate(rows)], frame.schema)


def test_missing_and_added_records(spark, good):
    short = rewritten(spark, good.where("key <> 3 or key is null"))
    assert found(good, short) == brute(good, short) == [(3, 0)]
    assert found(short, good) == brute(short, good) == [(3, 0)]
    added = warc.audit(short, good).where("corrupt").collect()
    assert len(added) == 1 and added[0].archive < 0 and added[0].digest is None
    both = rewritten(spark, good.where("key not in (3, 39) or key is null").withColumn("record", F.when(F.expr("key = 20"), F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("record"))))
    assert found(good, both) == brute(good, both) == [(20, 0), (3, 0), (39, 0)]


def test_only_mismatching_branches_are_read(good, monkeypatch):
    """One changed length leaves every node outside of its path equal."""
    bad = good.withColumn("record", F.when(F.expr("key = 3"), F.encode(F.lit("gone"), "UTF-8")).otherwise(F.col("record")))
    a, b = (warc.tree_levels(warc.digests(x)) for x in (good, bad))
    for one, two in zip(a, b, strict=True):
        assert one.exceptAll(two).count() == 1


def strict_records(raw):
    """The records of an archive, read as the format demands: header fields and block of each."""
    out = []
    while raw:
        head, raw = raw.split(b"\r\n\r\n", 1)
        first, *lines = head.decode("utf-8").split("\r\n")
        assert first == "WARC/1.1" and all(re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+: [^\x00-\x1f\x7f]+", x) for x in lines), head
        fields = dict(x.split(": ", 1) for x in lines)
        assert len(fields) == len(lines) and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= set(fields)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        assert re.fullmatch(r"[a-z]+:(?:[A-Za-z0-9;/?:@&=+$,_.!~*'()\[\]#-]|%[0-9A-F]{2})+", fields["WARC-Target-URI"]), fields
        n = int(fields["Content-Length"])
        block, end, raw = raw[:n], raw[n : n + 4], raw[n + 4 :]
        assert end == b"\r\n\r\n" and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        out.append((fields, block))
    return out


def test_records_pass_a_strict_reader(spark, good):
    odd = [(1, "http://h/a b\r\nWARC-Type: x", "one"), (1, "http://h/a b\r\nWARC-Type: x", "one"), (2, "http://h/\u00fc?q=<1>#\"", "\r\n\r\nWARC/1.1"), (3, "", ""), (None, None, None), (4, "http://h/100%25", "x" * 100_000)]
    made = warc.archives(spark.createDataFrame(odd, "page_id long, url string, html string"), 4)
    for replica, n in ((made, 6), (good, 48)):
        files = {}
        for r in sorted(replica.collect(), key=lambda r: (r.archive, r.slot)):
            files[r.archive] = files.get(r.archive, b"") + bytes(r.record)
        found = [x for raw in files.values() for x in strict_records(raw)]
        assert len(found) == n == len({fields["WARC-Record-ID"] for fields, _ in found})
    uris = {fields["WARC-Target-URI"] for r in made.collect() for fields, _ in strict_records(bytes(r.record))}
    assert uris == {"http://h/a%20b%0D%0AWARC-Type:%20x", "http://h/%C3%BC?q=%3C1%3E#%22", "about:blank", "http://h/100%25"}
