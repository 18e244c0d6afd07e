"""Rule tables on odd rows: nulls, ties, unknown types, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contract as C
from tidemark.operators.delivery import delivered


def test_taxonomy_takes_the_longest_alias(spark):
    taxonomy = spark.createDataFrame([("b", None, "Recusa"), ("a", "sub", "despacho DE recusa"), ("c", None, "recusa"), ("d", None, ""), ("d", None, None)], "event_type string, subtype string, alias string")
    rows = spark.createDataFrame([(1, "  Despácho  de\tRECUSA x"), (2, "recusas"), (3, None), (4, "")], "id int, t string")
    got = {r.id: (r.event_type, r.subtype, r.alias) for r in C.classified(rows, "t", taxonomy, "?").collect()}
    assert got == {1: ("a", "sub", "despacho de recusa"), 2: ("b", None, "recusa"), 3: ("?", None, None), 4: ("?", None, None)}
    assert C.classified(rows, "t", taxonomy.limit(0), "?").where("event_type = '?'").count() == 4
    many = spark.range(C.MAX_ALIASES + 1).select(F.lit("x").alias("event_type"), F.lit(None).cast("string").alias("subtype"), F.concat(F.lit("al"), "id").alias("alias"))
    with pytest.raises(ValueError, match="at most"):
        C.classified(rows, "t", many, "?")


def test_required_doubtful_and_unexpected_fields(spark):
    rules = spark.createDataFrame([("k", "a", "R"), ("k", "b", "Q"), ("k", "c", "Q"), ("k", "d", "N"), ("only", "a", "N")], "event_type string, field string, need string")
    rows = [(1, "k", "x", "x", None, None), (2, "k", "", "x", "x", "x"), (3, "k", "x", None, "", None), (4, "k", "x", None, "x", "x"), (5, "odd", "x", None, None, None), (6, None, None, None, None, None), (7, "only", None, None, None, None), (8, "only", "x", None, None, None)]
    got = C.validated(spark.createDataFrame(rows, "id int, kind string, a string, b string, c string, d string"), "kind", ["a", "b", "c", "d"], rules).collect()
    assert {r.id: (r.verdict, r.missing, r.doubtful, r.unexpected) for r in got} == {
        1: ("accept", [], [], []), 2: ("reject", ["a"], [], ["d"]), 3: ("quarantine", [], ["b", "c"], []), 4: ("review", [], [], ["d"]), 5: ("unknown_type", [], [], []), 6: ("unknown_type", [], [], []),
        7: ("accept", [], [], []), 8: ("review", [], [], ["a"])}


def test_confidence_sums_to_one_hundred(spark):
    assert sum(C.COMPONENTS.values()) == 100
    row = spark.range(1).select(C.confidence({n: F.lit(True) for n in C.COMPONENTS}).alias("all"), C.confidence({n: F.lit(None).cast("boolean") for n in C.COMPONENTS}).alias("none"))
    assert tuple(row.first()) == (100, 0)
    routes = spark.createDataFrame([(85,), (84,), (65,), (64,)], "s int").select(C.route(F.col("s"))).collect()
    assert [r[0] for r in routes] == ["automatic", "review", "review", "quarantine"]


def test_key_ignores_accents_spaces_and_empty_parts(spark):
    key = lambda section, basis, seen: C.semantic_key(F.lit("2024/01/02"), F.lit("2024-01-02").cast("date"), F.lit(section), F.lit("x"), F.lit("N.º 1 234"), F.lit(None).cast("date"), F.lit(basis).cast("string"), F.lit(seen).cast("string"))
    a, b, c, d = spark.range(1).select(key("Concessões", None, "  Obs "), key(" concessoes\n", "", "obs"), key("Concessões", None, "other"), key(None, None, None)).first()
    assert a == b != c and d.startswith("sha256:") and len(d) == 71


def test_archive_discovery_and_blocklist(spark):
    day = dt.date(2024, 1, 1)
    files = spark.createDataFrame([(day, "h1", "u1", 1), (day, "h1", "u2", 2), (day, "h2", "u1", 3), (None, "h3", "u", 4), (day, "h1", "u1", 5)], "day date, hash string, url string, seen int")
    assert {(r.hash, r.version, r.n_urls, r.supersedes, r.quarantined) for r in C.archived_versions(files).collect()} == {("h1", 1, 2, None, False), ("h2", 2, 1, "h1", True), ("h3", 1, 1, None, False)}
    links = spark.createDataFrame([(day, "a/x.pdf", "x.pdf", 2), (day, "a/x.pdf", "x.pdf", 1), (day, "b/x.pdf", "x.pdf", 3), (day, "c", None, 4), (day, "d", None, 5)], "day date, url string, file string, seen int")
    assert {(r.url, r.seen) for r in C.discovered(links).collect()} == {("a/x.pdf", 1), ("c", 4), ("d", 5)}
    at = lambda h: dt.datetime(2024, 1, 1, h)
    shown = spark.createDataFrame([("t", at(h)) for h in (1, 2, 5, 9)] + [("u", at(3)), (None, at(3))], "token_hash string, at timestamp")
    entries = spark.createDataFrame([("t", at(2), at(6)), ("t", at(4), at(9)), ("u", at(3), at(3))], "token_hash string, revoked_at timestamp, expires_at timestamp")
    assert {(r.token_hash, r.at.hour, r.blocked) for r in C.blocked(shown, entries).collect()} == {("t", 1, False), ("t", 2, True), ("t", 5, True), ("t", 9, False), ("u", 3, False), (None, 3, False)}


def test_constraints_and_queue(spark):
    schema = "channel string, event_version int, status string, attempts int, lease_owner string, lease_expires_at date, sent_at date, failed_at date, next_attempt_at date"
    d = dt.date(2024, 1, 1)
    good = [("email", 1, "pending", 0, None, None, None, None, d), ("email", 1, "sending", 1, "w", d, None, None, None), ("email", 2, "sent", 1, None, None, d, None, None), ("email", 1, "dead", 5, None, None, None, d, None)]
    bad = [("sms", 0, "odd", -1, "w", None, d, None, None), ("email", 1, "sent", 1, None, None, None, None, d), ("email", 1, "dead", 1, None, None, None, None, None), ("email", 1, "sending", 1, None, d, None, None, None)]
    breaks = lambda rows: {r.constraint: r.n_broken for r in C.constraint_breaks(spark.createDataFrame(rows, schema), C.outbox_constraints()).collect()}
    assert set(breaks(good).values()) == {0} and len(breaks(good)) == 8
    assert breaks(good + bad) == {"channel_valid": 1, "event_version_positive": 1, "status_valid": 1, "attempts_nonneg": 1, "lease_coherent": 2, "sent_at_coherent": 2, "dead_failed_at": 1, "terminal_no_retry": 1}
    rows = spark.createDataFrame([(1, "é\"", None), (2, None, 3.5)], "id int, name string, score double")
    queue = C.review_queue(rows, "mark", F.when(F.col("id") == 1, "odd"), F.col("id"), ["id", "name", "score"]).collect()
    assert [tuple(r) for r in queue] == [("mark", "1", "odd", '{"id":1,"name":"é\\"","score":null}')]


def test_one_failure_stops_no_other_message(spark, tmp_path):
    """Every message is sent once per run under the same id, whatever the others do."""
    box = tmp_path / "box"
    box.mkdir()

    def drop(message_id, recipient, subject, body):
        if body == "bad":
            raise ValueError("x" * 2000)
        (box / message_id).write_text(f"{recipient} {subject} {body}")

    rows = [("k1", "mail", "a", "s", "b"), ("k2", "mail", "a", None, "bad"), ("k3", "mail", None, "s", "b"), ("k4", "none", "a", "s", "b"), ("k5", None, "a", "s", "b"), (None, "mail", "c", None, None)] + [(f"n{k}", "mail", "a", "s", "b") for k in range(700)]
    df = spark.createDataFrame(rows, "dedupe_key string, channel string, recipient string, subject string, body string")
    for _ in range(2):
        got = {r.dedupe_key: (r.status, r.error) for r in delivered(df, {"mail": drop, "none": None}).collect()}
    assert got["k1"] == ("sent", None) == got[None] == got["n699"] and got["k2"] == ("failed", "x" * 500)
    assert got["k3"] == ("failed", "no recipient") and got["k4"] == ("skipped", None) and got["k5"] == ("failed", "unknown channel None")
    assert len(list(box.iterdir())) == 702 and delivered(df.limit(0), {}).count() == 0
