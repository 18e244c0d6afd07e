"""Routes of bulletin events against a plain loop, and what is shuffled for them."""

import datetime as dt
import random

from tidemark.operators.bulletin import route_events

KEYS = ["doc_id", "page_number", "raw_text", "event_type", "event_date", "application_number", "confidence_score"]


def test_routes_and_their_shuffles(spark):
    rng = random.Random(4)
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
    events = [(k, rng.randrange(3), rng.choice("ab"), rng.choice(["grant", "lapse", None]), rng.choice(days), rng.choice(["n1", "n2", "n3", "", None]), rng.choice([0.5, 0.9])) for k in range(120)]
    marks = [("n1", 1), ("n1", 2), ("n2", 1), ("n3", None)]
    known = [(1, "grant", days[0]), (2, "lapse", None), (2, None, days[1]), (None, "grant", days[0])]
    kinds = "doc_id long, page_number int, raw_text string, event_type string, event_date date, application_number string, confidence_score double"
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        routed = route_events(spark.createDataFrame(events, kinds), spark.createDataFrame(marks, "application_number string, mark_id long"), spark.createDataFrame(known, "mark_id long, event_type string, event_date date"))
        got = sorted((r.doc_id, r.mark_id or 0, r.route) for r in routed.collect())
        plan = routed._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = [(e, m) for e in events for m in ([m for n, m in marks if n == e[5]] or [None])]
    want, seen = [], set()
    for e, m in sorted(rows, key=lambda x: x[0][:3]):
        key = (m, e[3], e[4])
        turn = key in seen
        seen.add(key)
        old = e[3] is not None and m is not None and key in known
        want.append((e[0], m or 0, "review_no_number" if not e[5] else "review_unmatched" if m is None else "review_confidence" if e[6] < 0.6 else "duplicate" if old or turn else "insert"))
    assert got == sorted(want) and {r for *_, r in got} == {"review_no_number", "review_unmatched", "review_confidence", "duplicate", "insert"}
    assert sum("Exchange hashpartitioning" in line and "mark_id" in line for line in plan.splitlines()) <= 2  # the known ones, and the events once
