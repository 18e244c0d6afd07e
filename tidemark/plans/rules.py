"""Queries of the rule tables: taxonomy, required fields, confidence, keys, archive, constraints, blocklist, review queue, monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.contract import archived_versions, blocked, classified, confidence, constraint_breaks, discovered, drift_alarms, iso_country, outbox_constraints, review_queue, route, semantic_key, validated
from tidemark.operators.delivery import delivered
from tidemark.plans.base import SQL_MARK, mark_name, query, sql_fold
from tidemark.sources.registry import fixture_search, search_expression

# Parts of the bulletin's taxonomy.
_TAXONOMY = [
    ("application_published", None, "Publicação de pedidos"), ("application_published", None, "Pedido de registo"), ("grant_published", None, "Concessão"), ("refusal_published", None, "Despacho de recusa"),
    ("recordal_other", "invalidity_request", "declaração de nulidade"), ("recordal_other", "representative_change", "mandatário"), ("recordal_other", None, "Averbamento"),
]


def _sql_spaced(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(f'coalesce({x}, chr(0))')}, '\\s+', ' ', 'g'), chr(0) || ' ')"


_HEADING = "CASE o_orderkey % 9 WHEN 0 THEN 'PUBLICAÇÃO   de Pedidos ' WHEN 1 THEN 'pedido de registo nacional' WHEN 2 THEN 'Concessao' WHEN 3 THEN 'despacho de  RECUSA e averbamento' WHEN 4 THEN 'Averbamento: Declaração de nulidade' WHEN 5 THEN 'novo MANDATARIO' WHEN 6 THEN 'averbamentos' WHEN 7 THEN '' ELSE NULL END"


@query(
    "taxonomy_table",
    f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {f"'{s}'" if s else 'NULL'}, '{a}')" for k, s, a in _TAXONOMY)}) AS t(event_type, subtype, alias)),
x AS (SELECT o_orderkey, {_sql_spaced(f'({_HEADING})')} AS h FROM orders),
hits AS (SELECT o_orderkey, event_type, subtype, {_sql_spaced('alias')} AS a FROM x JOIN t ON contains(h, {_sql_spaced('alias')}) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY length(a) DESC, event_type, coalesce(subtype, ''), a) = 1)
SELECT o_orderkey, coalesce(event_type, 'unknown') AS event_type, subtype, a AS alias FROM orders LEFT JOIN hits USING (o_orderkey)""",
)
def taxonomy_table(read):
    """Types and subtypes of headings by a taxonomy that is a table; accents, case and spaces aside."""
    orders = read("orders")
    taxonomy = orders.sparkSession.createDataFrame(_TAXONOMY, "event_type string, subtype string, alias string")
    return classified(orders.select("o_orderkey", F.expr(_HEADING).alias("heading")), "heading", taxonomy, "unknown").drop("heading")


# Which fields a type requires (R), of which one is required or the event is held back (Q), and which are normally null (N).
_NEEDS = {
    "application": {"R": "application_number process_number application_date", "N": "registration_number refusal_date lapse_date legal_basis_text"},
    "grant": {"R": "process_number", "N": "application_date refusal_date lapse_date legal_basis_text"},
    "refusal": {"R": "process_number", "Q": "refusal_date legal_basis_text", "N": "lapse_date"},
    "renewal": {"R": "registration_number", "N": "application_number application_date refusal_date lapse_date legal_basis_text"},
}
_RULES = [(kind, field, need) for kind, needs in _NEEDS.items() for need, fields in needs.items() for field in fields.split()]
_VALUES = {
    "application_number": "event_id % 5 > 0", "registration_number": "event_id % 3 = 0", "process_number": "event_id % 7 > 0", "application_date": "user_id % 4 > 0", "refusal_date": "event_id % 2 = 0",
    "lapse_date": "event_id % 13 = 0", "legal_basis_text": "event_id % 11 > 5",
}
_KIND = "CASE event_type WHEN 'purchase' THEN 'application' WHEN 'signup' THEN 'grant' WHEN 'error' THEN 'refusal' WHEN 'click' THEN 'renewal' ELSE event_type END"


@query(
    "required_fields_table",
    f"""WITH rules AS (SELECT * FROM (VALUES {', '.join(map(str, _RULES))}) AS t(kind, field, need)),
e AS (SELECT event_id, {_KIND} AS kind, list_filter([{', '.join(f"CASE WHEN {c} THEN '{f}' END" for f, c in _VALUES.items())}], lambda x: x IS NOT NULL) AS present FROM events),
j AS (SELECT event_id, e.kind, count(field) AS n, coalesce(list(field ORDER BY field) FILTER (need = 'R' AND NOT list_contains(present, field)), []) AS missing,
    count(*) FILTER (need = 'Q') AS q, count(*) FILTER (need = 'Q' AND list_contains(present, field)) AS q_there, coalesce(list(field ORDER BY field) FILTER (need = 'N' AND list_contains(present, field)), []) AS unexpected FROM e LEFT JOIN rules USING (kind) GROUP BY ALL)
SELECT event_id, kind, array_to_string(missing, ',') AS missing, array_to_string(unexpected, ',') AS unexpected,
    CASE WHEN n = 0 THEN 'unknown_type' WHEN len(missing) > 0 THEN 'reject' WHEN q > 0 AND q_there = 0 THEN 'quarantine' WHEN len(unexpected) > 0 THEN 'review' ELSE 'accept' END AS verdict FROM j""",
)
def required_fields_table(read):
    """Events against a table of required, doubtful and unexpected fields per type."""
    events = read("events")
    rules = events.sparkSession.createDataFrame(_RULES, "event_type string, field string, need string")
    rows = events.select("event_id", F.expr(_KIND).alias("kind"), *[F.expr(f"CASE WHEN {c} THEN 'x' END").alias(f) for f, c in _VALUES.items()])
    return validated(rows, "kind", list(_VALUES), rules).select("event_id", "kind", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), "verdict")


_PARTS = {
    "section_known": "l_returnflag <> 'R'", "number_valid": "l_orderkey % 10 > 0", "act_date_valid": "l_shipdate >= TIMESTAMP '1996-01-01'", "page_consistent": "l_linenumber <= 5", "classes_valid": "l_quantity BETWEEN 1 AND 45",
    "headers_aligned": "l_tax < 0.05", "critical_field": "l_linestatus = 'F' OR l_orderkey % 3 = 0",
}


@query(
    "seven_components",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, {' + '.join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in zip(_PARTS.values(), (20, 20, 15, 15, 10, 10, 10), strict=True))} AS score FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, score::INT AS score, CASE WHEN score >= 85 THEN 'automatic' WHEN score >= 65 THEN 'review' ELSE 'quarantine' END AS route FROM s""",
)
def seven_components(read):
    """The seven weighted components of an event's confidence and where it goes."""
    score = confidence({name: F.expr(c) for name, c in _PARTS.items()})
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.cast("int").alias("score"), route(score).alias("route"))


_OBS = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ' Obs  ' || o_custkey END"


@query(
    "semantic_keys_nine",
    f"""SELECT o_orderkey, 'sha256:' || sha256(concat_ws('|', 'BPI', strftime(o_orderdate, '%Y/%m/%d'), CAST(CAST(o_orderdate AS DATE) AS VARCHAR), {_sql_spaced('o_orderpriority')}, o_orderstatus, regexp_replace('N.º 12 ' || o_orderkey, '[^0-9]', '', 'g'),
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) + 3 AS VARCHAR) END, {_sql_spaced("CASE WHEN o_orderkey % 2 = 0 THEN 'Art.  209' END")}, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE substr(sha256({_sql_spaced(f'({_OBS})')}), 1, 16) END)) AS dedupe_key FROM orders""",
)
def semantic_keys_nine(read):
    """The dedupe key of an event from all nine parts."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    key = semantic_key(F.date_format("o_orderdate", "yyyy/MM/dd"), day, F.col("o_orderpriority"), F.col("o_orderstatus"), F.concat(F.lit("N.º 12 "), k.cast("string")), F.when(k % 3 > 0, F.date_add(day, 3)), F.when(k % 2 == 0, "Art.  209"), F.expr(_OBS))
    return read("orders").select("o_orderkey", key.alias("dedupe_key"))


_COUNTRIES = "PT US DE ES FR GB IT NL BE CH CN JP KR BR AO MZ".split()
_CODE = "CASE c_custkey % 6 WHEN 0 THEN ' pt' WHEN 1 THEN 'De' WHEN 2 THEN 'XX' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'usa' END"


@query("canonical_countries", f"SELECT c_custkey, CASE WHEN upper(trim({_CODE})) IN ({', '.join(f"'{c}'" for c in _COUNTRIES)}) THEN upper(trim({_CODE})) END AS country FROM customer")
def canonical_countries(read):
    """Countries as known ISO codes in capitals; unknown ones are null, not guessed."""
    return read("customer").select("c_custkey", iso_country(F.expr(_CODE), _COUNTRIES).alias("country"))


_FILES = "SELECT CAST(DATE '2024-01-01' + (doc_id % 97)::INT AS DATE) AS day, sha256(coalesce(text, '')) AS hash, 'https://h/' || source || '/' || (doc_id % 5) AS url, doc_id AS seen FROM documents"


@query(
    "archive_quarantine",
    f"""WITH f AS ({_FILES}), g AS (SELECT day, hash, min(seen) AS seen, count(DISTINCT url) AS n_urls FROM f GROUP BY ALL)
SELECT day, hash, seen, n_urls, row_number() OVER w::INT AS version, lag(hash) OVER w AS supersedes, row_number() OVER w > 1 AS quarantined FROM g WINDOW w AS (PARTITION BY day ORDER BY seen, hash)""",
)
def archive_quarantine(read):
    """Z3: another content for an archived day is a new version that supersedes the last and is quarantined; another URL isn't."""
    k = F.col("doc_id")
    files = read("documents").select(F.date_add(F.lit("2024-01-01").cast("date"), (k % 97).cast("int")).alias("day"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.concat(F.lit("https://h/"), "source", F.lit("/"), (k % 5).cast("string")).alias("url"), k.alias("seen"))
    return archived_versions(files).select("day", "hash", "seen", "n_urls", "version", "supersedes", "quarantined")


@query(
    "link_discovery",
    """WITH l AS (SELECT CAST(DATE '2024-01-01' + (page_id % 10)::INT AS DATE) AS day, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS url, page_id AS seen FROM pages),
u AS (SELECT day, url, min(seen) AS seen, nullif(regexp_extract(url, '([^/]+)$', 1), '') AS file FROM l GROUP BY day, url)
SELECT day, url, file, seen FROM u QUALIFY row_number() OVER (PARTITION BY day, coalesce(file, url) ORDER BY seen, url) = 1""",
)
def link_discovery(read):
    """Links of listing pages without repeats, by day and URL, then by day and file name."""
    url = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    links = read("pages").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 10).cast("int")).alias("day"), url.alias("url"), F.col("page_id").alias("seen"))
    name = F.regexp_extract("url", "([^/]+)$", 1)
    return discovered(links.withColumn("file", F.when(name != "", name)))


_SQL_BOX = """box AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'sms' ELSE 'email' END AS channel, (event_id % 9)::INT AS event_version, ['pending', 'sending', 'sent', 'dead', 'lost'][(event_id % 5 + 1)::INT] AS status, (event_id % 7)::INT - 1 AS attempts,
    CASE WHEN event_id % 5 = 1 AND event_id % 4 > 0 THEN 'w1' END AS lease_owner, CASE WHEN event_id % 5 = 1 THEN ts END AS lease_expires_at, CASE WHEN event_id % 5 = 2 OR event_id % 31 = 0 THEN ts END AS sent_at,
    CASE WHEN event_id % 5 = 3 AND event_id % 2 = 0 THEN ts END AS failed_at, CASE WHEN event_id % 5 < 3 AND event_id % 3 = 0 THEN ts END AS next_attempt_at FROM events)"""
_SQL_CHECKS = {
    "channel_valid": "channel IN ('email')", "event_version_positive": "event_version > 0", "status_valid": "status IN ('pending', 'sending', 'sent', 'dead')", "attempts_nonneg": "attempts >= 0",
    "lease_coherent": "(status = 'sending' AND lease_owner IS NOT NULL AND lease_expires_at IS NOT NULL) OR (status <> 'sending' AND lease_owner IS NULL AND lease_expires_at IS NULL)",
    "sent_at_coherent": "(status = 'sent') = (sent_at IS NOT NULL)", "dead_failed_at": "status <> 'dead' OR failed_at IS NOT NULL", "terminal_no_retry": "status NOT IN ('sent', 'dead') OR next_attempt_at IS NULL",
}


@query("outbox_constraints", f"WITH {_SQL_BOX} " + " UNION ALL ".join(f"SELECT '{n}' AS \"constraint\", count(*) FILTER (NOT ({c})) AS n_broken FROM box" for n, c in _SQL_CHECKS.items()))
def outbox_constraint_breaks(read):
    """How many rows break each of the eight state constraints."""
    i, ts = F.col("event_id"), F.col("ts")
    box = read("events").select(
        F.when(i % 50 == 0, "sms").otherwise("email").alias("channel"), (i % 9).cast("int").alias("event_version"), F.element_at(F.array(*map(F.lit, ("pending", "sending", "sent", "dead", "lost"))), (i % 5 + 1).cast("int")).alias("status"), ((i % 7) - 1).cast("int").alias("attempts"),
        F.when((i % 5 == 1) & (i % 4 > 0), "w1").alias("lease_owner"), F.when(i % 5 == 1, ts).alias("lease_expires_at"), F.when((i % 5 == 2) | (i % 31 == 0), ts).alias("sent_at"), F.when((i % 5 == 3) & (i % 2 == 0), ts).alias("failed_at"),
        F.when((i % 5 < 3) & (i % 3 == 0), ts).alias("next_attempt_at"),
    )
    return constraint_breaks(box, outbox_constraints())


@query(
    "token_blocklist",
    """WITH b AS (SELECT sha256('t' || user_id) AS h, min(ts) AS f, max(ts + INTERVAL 2 DAY) AS t FROM events WHERE event_type = 'error' AND event_id % 20 = 0 GROUP BY 1)
SELECT event_id, coalesce(f <= ts AND ts < t, false) AS blocked FROM events LEFT JOIN b ON sha256('t' || user_id) = h""",
)
def token_blocklist(read):
    """Presented tokens against a blocklist by hash, whose entries end with their token."""
    token = F.sha2(F.concat(F.lit("t"), F.col("user_id").cast("string")), 256)
    events = read("events")
    entries = events.where("event_type = 'error' AND event_id % 20 = 0").select(token.alias("token_hash"), F.col("ts").alias("revoked_at"), (F.col("ts") + F.expr("interval 2 days")).alias("expires_at"))
    return blocked(events.select("event_id", token.alias("token_hash"), F.col("ts").alias("at")), entries).select("event_id", "blocked")


@query(
    "review_queue",
    """SELECT 'trademark' AS entity, o_orderkey::VARCHAR AS entity_id, CASE WHEN o_orderkey % 7 = 0 THEN 'missing_number' ELSE 'low_confidence' END AS reason,
    json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'number', CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey::VARCHAR END, 'o_orderpriority', o_orderpriority)::VARCHAR AS payload FROM orders WHERE o_orderkey % 7 = 0 OR o_orderstatus = 'P'""",
)
def review_queue_rows(read):
    """K5: rows that wait for review, with why and what, as JSON."""
    k = F.col("o_orderkey")
    rows = read("orders").withColumn("number", F.when(k % 7 > 0, k.cast("string")))
    reason = F.when(k % 7 == 0, "missing_number").when(F.col("o_orderstatus") == "P", "low_confidence")
    return review_queue(rows, "trademark", reason, k, ["o_orderkey", "o_custkey", "number", "o_orderpriority"])


@query(
    "drift_alarms",
    """WITH p AS (SELECT source AS bulletin, lang AS section, doc_id % 50 AS process, n_chars, sha256(coalesce(text, '')) AS hash, CAST(DATE '2024-01-01' + (doc_id % 400)::INT AS DATE) AS day FROM documents),
low AS (SELECT bulletin, (count(*) FILTER (n_chars < 400))::DOUBLE / count(*) AS value FROM p GROUP BY 1),
new AS (SELECT bulletin, section, count(DISTINCT process)::DOUBLE AS value FROM p WHERE section NOT IN ('en', 'de') GROUP BY ALL), changed AS (SELECT bulletin, day, (count(DISTINCT hash) - 1)::DOUBLE AS value FROM p GROUP BY ALL)
SELECT bulletin, 'low_text_share' AS monitor, NULL::VARCHAR AS subject, value, value > 0.2 AS alarm FROM low UNION ALL SELECT bulletin, 'new_section', section, value, value > 5 FROM new
UNION ALL SELECT bulletin, 'hash_change', day::VARCHAR, value, value > 0 FROM changed""",
)
def drift_alarms_of_documents(read):
    """The monitors for pages without text, for unknown sections and for contents that changed."""
    k = F.col("doc_id")
    pages = read("documents").select(F.col("source").alias("bulletin"), F.col("lang").alias("section"), (k % 50).alias("process"), "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")).alias("day"))
    return drift_alarms(pages, ["en", "de"], low_text=400)


def _mailed(message_id: str, recipient: str, subject: str, body: str) -> None:
    """A transport without a network: it refuses mailboxes that are full."""
    if recipient.startswith("full-"):
        raise OSError(f"mailbox {recipient} is full")


_CHANNEL = "CASE event_id % 4 WHEN 0 THEN 'telegram' WHEN 1 THEN 'fax' ELSE 'email' END"
_RECIPIENT = "CASE event_id % 5 WHEN 0 THEN 'full-' || user_id WHEN 1 THEN ' ' ELSE 'user-' || user_id END"


@query(
    "delivery_records",
    f"""WITH m AS (SELECT 'alert-' || event_id AS dedupe_key, {_CHANNEL} AS channel, {_RECIPIENT} AS recipient FROM events WHERE event_type = 'error')
SELECT dedupe_key, sha256(dedupe_key) AS message_id, channel, recipient, CASE WHEN channel = 'telegram' THEN 'skipped' WHEN channel = 'fax' OR recipient = ' ' OR recipient LIKE 'full-%' THEN 'failed' ELSE 'sent' END AS status,
    CASE WHEN channel = 'telegram' THEN NULL WHEN channel = 'fax' THEN 'unknown channel fax' WHEN recipient = ' ' THEN 'no recipient' WHEN recipient LIKE 'full-%' THEN 'mailbox ' || recipient || ' is full' END AS error FROM m""",
)
def delivery_records(read):
    """K6: messages sent from the tasks over the channel's transport, and the record of each."""
    alerts = read("events").where("event_type = 'error'")
    messages = alerts.select(F.concat(F.lit("alert-"), F.col("event_id").cast("string")).alias("dedupe_key"), F.expr(_CHANNEL).alias("channel"), F.expr(_RECIPIENT).alias("recipient"), F.lit("Alert").alias("subject"), F.col("props").alias("body"))
    return delivered(messages, {"email": _mailed, "telegram": None})


@query(
    "fixture_searches",
    f"""WITH m AS (SELECT p_partkey, {SQL_MARK} AS word_mark, 'N-' || p_partkey AS application_number FROM part), q AS (SELECT * FROM (VALUES ('WIDGET', 'wordMark==*WIDGET*;jurisdiction==PT'), ('n-77', 'wordMark==*n-77*;jurisdiction==PT'), ('nothing like it', 'wordMark==*nothing like it*;jurisdiction==PT')) AS t(text, asked)),
h AS (SELECT *, contains(lower(word_mark), lower(text)) OR contains(lower(application_number), lower(text)) AS hit FROM m, q), a AS (SELECT text, bool_or(hit) AS found FROM h GROUP BY text)
SELECT asked, p_partkey FROM h JOIN a USING (text) WHERE hit OR NOT found""",
)
def fixture_searches(read):
    """A source's search by text in mark and number, which gives all rows where none has it, with the predicate that was asked."""
    marks = read("part").select("p_partkey", mark_name().alias("word_mark"), F.concat(F.lit("N-"), F.col("p_partkey").cast("string")).alias("application_number"))
    found = [fixture_search(marks, text).select(F.lit(search_expression(text, "PT")).alias("asked"), "p_partkey") for text in ("WIDGET", "n-77", "nothing like it")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "ocr_pages",
    r"""WITH p AS (SELECT page_id, length(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<(script|style|head|nav)[^>]*>.*?</(script|style|head|nav)>|<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'))) AS chars, len(regexp_extract_all(coalesce(html, ''), '<(img|div class="ad")')) AS images,
    regexp_extract(coalesce(url, ''), '^[a-z]+://[^/]+/([^/?#]*)', 1) AS section FROM pages)
SELECT page_id, chars::INT AS chars, images::INT AS images, section FROM p WHERE chars < 2500 AND images > 0 AND starts_with(section, 'e')""",
)
def ocr_pages(read):
    """Pages of a section with little text and with images, which go to OCR; text, images and section are the page's own."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "(?s)<(script|style|head|nav)[^>]*>.*?</(script|style|head|nav)>|<[^>]*>", " "), r"\s+", " ")
    images = F.regexp_count(F.coalesce("html", F.lit("")), F.lit('<(img|div class="ad")'))
    section = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://[^/]+/([^/?#]*)", 1)
    pages = read("pages").select("page_id", F.length(F.trim(plain)).alias("chars"), images.alias("images"), section.alias("section"))
    return pages.where((F.col("chars") < 2500) & (F.col("images") > 0) & F.col("section").startswith("e"))
