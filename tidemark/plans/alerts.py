"""Alerts, policy and delivery queries over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import html_escaped
from tidemark.operators.blocks import greedy_windows
from tidemark.operators.outbox import claim, enqueue, not_recently_alerted, settle, suppress_repeats, without_denied
from tidemark.plans.base import SQL_MARK, mark_name, query

NOW = "2024-01-20 12:00:00"


@query(
    "alert_dedup_24h",
    """WITH t AS (SELECT user_id, event_type, list_sort(list(epoch_us(ts))) AS ts FROM events GROUP BY ALL),
k AS (SELECT user_id, event_type, list_reduce(ts, lambda kept, t: CASE WHEN t[1] - kept[-1] > 86400000000 THEN list_concat(kept, t) ELSE kept END) AS kept FROM (SELECT user_id, event_type, list_transform(ts, lambda x: [x]) AS ts FROM t))
SELECT user_id, event_type, unnest(kept) AS emitted_micros FROM k""",
)
def alert_dedup(read):
    """X11: an alert is suppressed for 24 hours after the last emitted one of its kind."""
    return suppress_repeats(read("events"), ["user_id", "event_type"], "ts")


@query(
    "alert_antijoin_24h",
    """SELECT event_id, user_id, ts FROM events c WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'signup' AND a.user_id = c.user_id AND a.ts >= c.ts - INTERVAL 24 HOUR AND a.ts < c.ts)""",
)
def alert_antijoin(read):
    """Candidates without an alert in the 24 hours before."""
    events = read("events")
    old = events.where("event_type = 'signup'").select("user_id", "ts")
    return not_recently_alerted(events.where("event_type = 'error'").select("event_id", "user_id", "ts"), old, ["user_id"], "ts")


@query(
    "deny_antijoin",
    """SELECT o_orderkey, o_custkey FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'machinery')) d ON c_custkey = o_custkey WHERE c_custkey IS NULL""",
)
def deny_antijoin(read):
    """Marks whose source is not denied."""
    sources = read("customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("name"))
    return without_denied(read("orders").select("o_orderkey", "o_custkey"), "o_custkey", sources, ["BUILDING ", "machinery"])


@query(
    "alert_templates",
    """SELECT o_orderkey, coalesce(map {'1-URGENT': 'Renovação em breve', '2-HIGH': 'Prazo de oposição', '3-MEDIUM': 'Prazo para resposta a recusa'}[o_orderpriority], 'Prazo importante') AS title,
    format('Similaridade textual: {:.1f} | {}', (o_custkey % 1000) / 10.0::DOUBLE, replace(replace(o_orderpriority, '&', '&amp;'), '<', '&lt;')) AS body FROM orders""",
)
def alert_templates(read):
    """Titles and bodies with default labels."""
    labels = F.create_map(*[F.lit(x) for x in ("1-URGENT", "Renovação em breve", "2-HIGH", "Prazo de oposição", "3-MEDIUM", "Prazo para resposta a recusa")])
    title = F.coalesce(F.try_element_at(labels, F.col("o_orderpriority")), F.lit("Prazo importante"))
    return read("orders").select("o_orderkey", title.alias("title"), F.format_string("Similaridade textual: %.1f | %s", (F.col("o_custkey") % 1000) / 10.0, html_escaped(F.col("o_orderpriority"))).alias("body"))


_SQL_OUTBOX = f"""box AS (SELECT event_id AS id, user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS dedupe_key, ts AS created_at, ['pending', 'sending', 'sent', 'dead'][(event_id % 4 + 1)::INT] AS status, (event_id % 6)::INT AS attempts,
    CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS next_attempt_at, CASE WHEN event_id % 2 = 0 THEN 'w1' ELSE 'w2' END AS lease_owner, ts + INTERVAL 2 DAY AS lease_expires_at FROM events)"""


def _outbox(read):
    e = read("events")
    i = F.col("event_id")
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))
    states = F.array(*[F.lit(s) for s in ("pending", "sending", "sent", "dead")])
    return e.select(
        i.alias("id"), key.alias("dedupe_key"), F.col("ts").alias("created_at"), F.element_at(states, (i % 4 + 1).cast("int")).alias("status"), (i % 6).cast("int").alias("attempts"),
        F.when(i % 3 == 0, F.col("ts") + F.expr("interval 1 day")).alias("next_attempt_at"), F.when(i % 2 == 0, "w1").otherwise("w2").alias("lease_owner"), (F.col("ts") + F.expr("interval 2 days")).alias("lease_expires_at"),
    )


@query(
    "outbox_claim",
    f"""WITH {_SQL_OUTBOX} SELECT id, 'sending' AS status, attempts + 1 AS attempts, 'w9' AS lease_owner, TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE AS lease_expires_at FROM box
WHERE (status = 'pending' AND coalesce(next_attempt_at, TIMESTAMP '{NOW}') <= TIMESTAMP '{NOW}') OR (status = 'sending' AND lease_expires_at <= TIMESTAMP '{NOW}') ORDER BY created_at, id LIMIT 100""",
)
def outbox_claim(read):
    """The oldest due rows are leased."""
    now = F.lit(NOW).cast("timestamp")
    return claim(_outbox(read), now, "w9", 100).select("id", "status", "attempts", "lease_owner", "lease_expires_at")


@query(
    "outbox_transition",
    f"""WITH {_SQL_OUTBOX}, r AS (SELECT *, ['sent', 'retry', 'permanent'][(id % 3 + 1)::INT] AS result, coalesce(status = 'sending' AND lease_owner = 'w1' AND lease_expires_at > TIMESTAMP '{NOW}', false) AS live FROM box WHERE status = 'sending' OR status = 'pending'),
s AS (SELECT *, CASE WHEN NOT live THEN 'rejected' WHEN result = 'sent' THEN 'sent' WHEN result = 'permanent' OR attempts >= 5 THEN 'dead' ELSE 'pending' END AS new_status FROM r)
SELECT id, result, new_status, CASE WHEN new_status = 'pending' THEN least(3600.0::DOUBLE, pow(2, least(attempts, 10)) + ('0x' || substr(md5(attempts || ':' || id), 1, 6))::BIGINT % 31) END AS retry_seconds FROM s""",
)
def outbox_transition(read):
    """Complete, retry, give up, or reject a stale worker."""
    i = F.col("id")
    result = F.element_at(F.array(*[F.lit(s) for s in ("sent", "retry", "permanent")]), (i % 3 + 1).cast("int"))
    leased = _outbox(read).where(F.col("status").isin("sending", "pending")).withColumn("result", result)
    leased = leased.withColumn("status", F.when((i % 4) == 1, "sending").otherwise(F.col("status")))
    return settle(leased, F.lit(NOW).cast("timestamp"), "w1").select("id", "result", "new_status", "retry_seconds")


@query(
    "outbox_dedupe",
    f"""WITH {_SQL_OUTBOX}, old AS (SELECT dedupe_key FROM box WHERE id % 2 = 0), batch AS (SELECT * FROM box WHERE id % 2 = 1)
SELECT id, dedupe_key FROM batch WHERE dedupe_key NOT IN (SELECT dedupe_key FROM old) QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY created_at, id) = 1""",
)
def outbox_dedupe(read):
    """Insert or keep the existing row of a dedupe key."""
    box = _outbox(read)
    return enqueue(box.where("id % 2 = 0"), box.where("id % 2 = 1"), "dedupe_key", ["created_at", "id"]).select("id", "dedupe_key")


@query("outbox_coherence", f"WITH {_SQL_OUTBOX} SELECT count(*) FILTER (status = 'pending' AND next_attempt_at < created_at) AS early, count(*) FILTER (attempts < 0) AS negative, count(*) FILTER (status = 'sending' AND lease_expires_at IS NULL) AS unleased, count(*) AS n FROM box")
def outbox_coherence(read):
    """Rows that break a state constraint."""
    return _outbox(read).agg(F.count_if((F.col("status") == "pending") & (F.col("next_attempt_at") < F.col("created_at"))).alias("early"), F.count_if(F.col("attempts") < 0).alias("negative"), F.count_if((F.col("status") == "sending") & F.col("lease_expires_at").isNull()).alias("unleased"), F.count(F.lit(1)).alias("n"))


@query("dispatch_counters", f"WITH {_SQL_OUTBOX} SELECT lease_owner, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'dead') AS failed, count(*) FILTER (status = 'pending') AS blocked, count(*) AS total FROM box GROUP BY 1")
def dispatch_counters(read):
    """Counters of a dispatch run."""
    hit = lambda s: F.count_if(F.col("status") == s)
    return _outbox(read).groupBy("lease_owner").agg(hit("sent").alias("sent"), hit("dead").alias("failed"), hit("pending").alias("blocked"), F.count(F.lit(1)).alias("total"))


@query(
    "hourly_issue_count",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events",
)
def hourly_issue_count(read):
    """Issues of the hour before, per user and purpose."""
    hour = Window.partitionBy("user_id", "event_type").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-3600, 0)
    return read("events").select("event_id", F.count(F.lit(1)).over(hour).alias("n"))


@query(
    "failed_login_window",
    """WITH t AS (SELECT user_id, list_sort(list(epoch_us(ts))) AS ts FROM events WHERE event_type = 'error' GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_transform(ts, lambda x: [{'opened': x, 'n': 1::BIGINT}]), lambda done, t: CASE WHEN t[1].opened < done[-1].opened + 900000000 THEN list_append(done[1:len(done) - 1], {'opened': done[-1].opened, 'n': done[-1].n + 1}) ELSE list_concat(done, t) END) AS w FROM t)
SELECT user_id, u.opened AS opened_micros, u.n AS n, u.n >= 5 AS locked FROM (SELECT user_id, unnest(w) AS u FROM f)""",
)
def failed_login_window(read):
    """Fixed windows of 15 minutes from the first failure."""
    failed = read("events").where("event_type = 'error'")
    windows = greedy_windows(failed, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), 900_000_000)
    return windows.withColumnRenamed("opened", "opened_micros").withColumn("locked", F.col("n") >= 5)


@query(
    "token_verification",
    f"""WITH t AS (SELECT event_id, sha256('token-' || event_id) AS h, event_id % 5 = 0 AS revoked, event_id % 7 = 0 AS used, ts + INTERVAL 1 DAY AS expires_at FROM events WHERE event_id % 2 = 0),
a AS (SELECT event_id, sha256('token-' || (event_id + event_id % 3)) AS h FROM events)
SELECT a.event_id, CASE WHEN t.h IS NULL THEN 'invalid' WHEN revoked THEN 'revoked' WHEN used THEN 'used' WHEN expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'verified' END AS outcome FROM a LEFT JOIN t ON a.h = t.h""",
)
def token_verification(read):
    """The verdict on presented tokens, matched by hash."""
    e = read("events")
    i = F.col("event_id")
    stored = e.where("event_id % 2 = 0").select(F.sha2(F.concat(F.lit("token-"), i.cast("string")), 256).alias("h"), (i % 5 == 0).alias("revoked"), (i % 7 == 0).alias("used"), (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"), F.lit(True).alias("found"))
    asked = e.select("event_id", F.sha2(F.concat(F.lit("token-"), (i + i % 3).cast("string")), 256).alias("h"))
    now = F.lit(NOW).cast("timestamp")
    outcome = F.when(F.col("found").isNull(), "invalid").when(F.col("revoked"), "revoked").when(F.col("used"), "used").when(F.col("expires_at") <= now, "expired").otherwise("verified")
    return asked.join(stored, "h", "left").select("event_id", outcome.alias("outcome"))


MOST_WATCHED = 255


@query(
    "watch_text_theta_join",
    f"""WITH items AS (SELECT lower(p_name) AS mark_text FROM part WHERE p_partkey % 20 = 0 UNION SELECT lower(p_type) FROM part WHERE p_partkey % 20 = 0), marks AS (SELECT DISTINCT {SQL_MARK} AS mark FROM part)
SELECT mark, min(mark_text) AS first_item, count(*) AS n FROM marks JOIN items ON mark ILIKE '%' || mark_text || '%' GROUP BY mark""",
)
def watch_text_theta(read):
    """The first watched text that a mark contains. A text of length n is found among the substrings of that length: an
    equi-join, no pair of texts is tried. Watched texts have ``MOST_WATCHED`` characters at most (P25), so there are no more lengths than that."""
    marks = read("part").select(mark_name().alias("mark")).distinct()
    watched = read("part").where("p_partkey % 20 = 0")
    items = watched.select(F.lower("p_name").alias("mark_text")).union(watched.select(F.lower("p_type"))).where("mark_text <> ''").distinct()
    lengths = [r[0] for r in items.select(F.least(F.length("mark_text"), F.lit(MOST_WATCHED + 1))).distinct().collect()]
    if max(lengths, default=0) > MOST_WATCHED:
        raise ValueError(f"a watched text has more than {MOST_WATCHED} characters")
    low = F.lower("mark")

    def substrings(n: int):
        every = F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: low.substr(i, F.lit(n)))
        return F.when(F.length(low) >= n, every).otherwise(F.array().cast("array<string>"))

    parts = F.array_distinct(F.flatten(F.array(*[substrings(n) for n in sorted(lengths)])))
    return marks.select("mark", F.explode(parts).alias("mark_text")).join(items, "mark_text").groupBy("mark").agg(F.min("mark_text").alias("first_item"), F.count(F.lit(1)).alias("n"))
