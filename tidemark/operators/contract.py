"""Rules that are data: taxonomy, required fields, weighted components, constraints, monitors, keys.

Rule tables are configuration. Those that are joined are left to the planner; a taxonomy goes into the plan as
literals, at most ``MAX_ALIASES`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fold

MAX_ALIASES = 2_000


def spaced(text: Column) -> Column:
    """Folded text with single spaces, as keys and headings are compared."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"\s+", " "))


def classified(rows: DataFrame, text: str, taxonomy: DataFrame, other: str) -> DataFrame:
    """The rows with event_type, subtype and alias of the longest alias in their text (ties: the least type, subtype and alias).

    taxonomy: event_type, subtype (null: the type itself), alias. Accents, case and white space don't count.
    """
    known = taxonomy.select("event_type", "subtype", spaced(F.col("alias")).alias("alias")).where("alias <> ''").distinct().limit(MAX_ALIASES + 1).collect()
    if len(known) > MAX_ALIASES:
        raise ValueError(f"a taxonomy has at most {MAX_ALIASES} aliases")
    known.sort(key=lambda r: (-len(r.alias), r.event_type, r.subtype or "", r.alias))
    kind = "struct<event_type:string,subtype:string,alias:string>"
    entries = F.array(*[F.struct(F.lit(r.event_type).alias("event_type"), F.lit(r.subtype).cast("string").alias("subtype"), F.lit(r.alias).alias("alias")) for r in known]).cast(f"array<{kind}>")
    folded = rows.withColumn("_folded", spaced(F.col(text)))
    # The entries are in order of preference, so the first one that is there is the one.
    hit = folded.withColumn("_hit", F.get(F.filter(entries, lambda e: F.contains(F.col("_folded"), e["alias"])), F.lit(0))).drop("_folded")
    return hit.withColumns({"event_type": F.coalesce("_hit.event_type", F.lit(other)), "subtype": F.col("_hit.subtype"), "alias": F.col("_hit.alias")}).drop("_hit")


def validated(events: DataFrame, kind: str, fields: list[str], rules: DataFrame) -> DataFrame:
    """The events with missing, doubtful and unexpected (field names) and a verdict.

    rules: event_type, field, need, where need is R (required), Q (of the type's Q fields one at least, else quarantine) or N (normally
    null). A required field that is missing rejects, then Q quarantines, then an unexpected one asks for review. A type
    without rules is ``unknown_type``.
    """
    per_type = rules.groupBy(F.col("event_type").alias("_type")).agg(*[F.array_sort(F.collect_set(F.when(F.col("need") == n, F.col("field")))).alias(f"_{n}") for n in "RQN"])
    present = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & (F.length(F.col(f).cast("string")) > 0), F.lit(f)) for f in fields]))
    joined = events.withColumn("_present", present).join(per_type, F.col(kind) == F.col("_type"), "left")
    none = F.array().cast("array<string>")
    lacks = F.size(F.col("_Q")) > F.size(F.array_except("_Q", "_present"))
    missing = F.coalesce(F.array_except("_R", "_present"), none)
    doubtful = F.when((F.size("_Q") > 0) & ~lacks, F.col("_Q")).otherwise(none)
    unexpected = F.coalesce(F.array_sort(F.array_intersect("_N", "_present")), none)
    verdict = F.when(F.col("_type").isNull(), "unknown_type").when(F.size(missing) > 0, "reject").when(F.size(doubtful) > 0, "quarantine").when(F.size(unexpected) > 0, "review").otherwise("accept")
    return joined.withColumns({"missing": missing, "doubtful": doubtful, "unexpected": unexpected, "verdict": verdict}).drop("_present", "_type", "_R", "_Q", "_N")


#: The components of an event's confidence in hundredths, and the least scores that are accepted and reviewed.
COMPONENTS = {"section_known": 20, "number_valid": 20, "act_date_valid": 15, "page_consistent": 15, "classes_valid": 10, "headers_aligned": 10, "critical_field": 10}
ACCEPT, REVIEW = 85, 65


def confidence(parts: dict[str, Column]) -> Column:
    """Summed hundredths of the components that hold; a null component doesn't."""
    return sum((F.when(F.coalesce(parts[name], F.lit(False)), weight).otherwise(0) for name, weight in COMPONENTS.items()), F.lit(0))


def route(score: Column) -> Column:
    return F.when(score >= ACCEPT, "automatic").when(score >= REVIEW, "review").otherwise("quarantine")


def semantic_key(bulletin: Column, published: Column, section: Column, kind: Column, number: Column, acted: Column, basis: Column, observations: Column) -> Column:
    """The dedupe key of an event: SHA-256 over nine parts, the last one 16 hex digits of the observations' own hash."""
    noted = spaced(observations)
    empty = F.lit("")
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.lit("BPI"), F.coalesce(bulletin, empty), F.coalesce(published.cast("string"), empty), spaced(section), F.coalesce(kind, empty), F.regexp_replace(F.coalesce(number, empty), "[^0-9]", ""),
        F.coalesce(acted.cast("string"), empty), spaced(basis), F.when(noted == "", empty).otherwise(F.substring(F.sha2(noted, 256), 1, 16))), 256))


def iso_country(code: Column, known: list[str]) -> Column:
    """The code in capitals if it is one of the known ISO codes, else null."""
    tidy = F.upper(F.trim(code))
    return F.when(tidy.isin(*known), tidy)


def archived_versions(files: DataFrame) -> DataFrame:
    """day, hash, version, seen, n_urls, supersedes, quarantined of a bulletin archive.

    files: day, hash, url, seen (order of discovery). The same content under another URL is one version with more URLs; another content for a
    day is the next version, which supersedes the one before and waits for review.
    """
    first = files.groupBy("day", "hash").agg(F.min("seen").alias("seen"), F.count_distinct("url").alias("n_urls"))
    order = Window.partitionBy("day").orderBy("seen", "hash")
    return first.withColumns({"version": F.row_number().over(order), "supersedes": F.lag("hash").over(order)}).withColumn("quarantined", F.col("version") > 1)


def discovered(links: DataFrame) -> DataFrame:
    """The first link of each (day, url), and of those the first of each (day, file name); links: day, url, file, seen."""
    by_url = links.groupBy("day", "url").agg(F.min(F.struct("seen", "file")).alias("f")).select("day", "url", "f.*")
    by_file = by_url.groupBy("day", F.coalesce("file", "url").alias("_name")).agg(F.min(F.struct("seen", "url", "file")).alias("f"))
    return by_file.select("day", "f.url", "f.file", "f.seen")


def constraint_breaks(rows: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """constraint, n_broken: rows for which a constraint is false (null passes), all counted in one pass."""
    counts = rows.agg(*[F.count_if(~c).alias(name) for name, c in constraints.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("constraint"), F.col(name).alias("n_broken")) for name in constraints])))


def outbox_constraints() -> dict[str, Column]:
    """The state constraints of the delivery outbox by name."""
    status = F.col("status")
    leased = F.col("lease_owner").isNotNull() & F.col("lease_expires_at").isNotNull()
    free = F.col("lease_owner").isNull() & F.col("lease_expires_at").isNull()
    return {
        "channel_valid": F.col("channel").isin("email"), "event_version_positive": F.col("event_version") > 0, "status_valid": status.isin("pending", "sending", "sent", "dead"), "attempts_nonneg": F.col("attempts") >= 0,
        "lease_coherent": ((status == "sending") & leased) | ((status != "sending") & free), "sent_at_coherent": (status == "sent") == F.col("sent_at").isNotNull(),
        "dead_failed_at": (status != "dead") | F.col("failed_at").isNotNull(), "terminal_no_retry": ~status.isin("sent", "dead") | F.col("next_attempt_at").isNull(),
    }


def blocked(presented: DataFrame, blocklist: DataFrame, at: str = "at") -> DataFrame:
    """The presented tokens (token_hash, at) with ``blocked``: revoked by then and not yet expired.

    blocklist: token_hash, revoked_at, expires_at. An entry is of use for its token's remaining lifetime only; a token that is
    revoked twice is blocked from the first time to the last end.
    """
    entries = blocklist.where("expires_at > revoked_at").groupBy(F.col("token_hash").alias("_hash")).agg(F.min("revoked_at").alias("_from"), F.max("expires_at").alias("_to"))
    joined = presented.join(entries, F.col("token_hash") == F.col("_hash"), "left")
    return joined.withColumn("blocked", F.coalesce((F.col("_from") <= F.col(at)) & (F.col(at) < F.col("_to")), F.lit(False))).drop("_hash", "_from", "_to")


def review_queue(rows: DataFrame, entity: str, reason: Column, key: Column, payload: list[str]) -> DataFrame:
    """Rows of the review queue: entity, entity_id, reason, payload (JSON with nulls), of the rows that have a reason."""
    queued = rows.withColumn("_reason", reason).where("_reason is not null")
    return queued.select(F.lit(entity).alias("entity"), key.cast("string").alias("entity_id"), F.col("_reason").alias("reason"), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"))


def drift_alarms(pages: DataFrame, known_sections: list[str], low_text: int = 100, most_low: float = 0.2, most_new: int = 5) -> DataFrame:
    """bulletin, monitor, subject, value, alarm of a bulletin's pages.

    pages: bulletin, section, process, n_chars, hash, day. Monitors: the share of pages with little text; processes in a section that isn't known; contents
    of a day beyond its first one.
    """
    low = pages.groupBy("bulletin").agg((F.count_if(F.col("n_chars") < low_text) / F.count(F.lit(1))).alias("value"))
    low = low.select("bulletin", F.lit("low_text_share").alias("monitor"), F.lit(None).cast("string").alias("subject"), "value", (F.col("value") > most_low).alias("alarm"))
    new = pages.where(F.col("section").isNotNull() & ~F.col("section").isin(*known_sections)).groupBy("bulletin", "section").agg(F.count_distinct("process").cast("double").alias("value"))
    new = new.select("bulletin", F.lit("new_section").alias("monitor"), F.col("section").alias("subject"), "value", (F.col("value") > most_new).alias("alarm"))
    changed = pages.groupBy("bulletin", "day").agg((F.count_distinct("hash") - 1).cast("double").alias("value"))
    changed = changed.select("bulletin", F.lit("hash_change").alias("monitor"), F.col("day").cast("string").alias("subject"), "value", (F.col("value") > 0).alias("alarm"))
    return low.unionByName(new).unionByName(changed)
