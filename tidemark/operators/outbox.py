"""Alert suppression, deny policy and the delivery outbox as state transitions over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import retry_delay
from tidemark.operators.blocks import greedy_windows

DAY_MICROS = 24 * 3600 * 1_000_000
MAX_ATTEMPTS = 5


def denied(source: Column, deny: list[str]) -> Column:
    """Whether a source label is on the deny list; null and empty labels are not."""
    return F.coalesce(F.lower(F.trim(source)).isin(*[d.strip().lower() for d in deny]), F.lit(False))


def without_denied(marks: DataFrame, key: str, sources: DataFrame, deny: list[str]) -> DataFrame:
    """Marks whose source key isn't denied; a null key stays. ``sources``: (key, name)."""
    bad = sources.where(denied(F.col("name"), deny)).select(F.col("key").alias("_key"))
    return marks.join(bad, F.col(key) == F.col("_key"), "left_anti")


def suppress_repeats(alerts: DataFrame, keys: list[str], ts: str, gap_micros: int = DAY_MICROS) -> DataFrame:
    """keys and the times (micros) of the alerts that are emitted: more than the gap after the last emitted one."""
    windows = greedy_windows(alerts, keys, F.unix_micros(F.col(ts).cast("timestamp")), gap_micros + 1)
    return windows.select(*keys, F.col("opened").alias("emitted_micros"))


def not_recently_alerted(candidates: DataFrame, alerts: DataFrame, keys: list[str], ts: str, gap_micros: int = DAY_MICROS) -> DataFrame:
    """Candidates without an alert of the same keys in the gap before them (bound included).

    Both sides are put in one order; a candidate looks at the last alert before it, so a key with many of both
    makes no pairs. Candidates with a null key or time have no alert before them.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).alias("_micros")
    both = candidates.select(*[F.col(c) for c in candidates.columns], micros, F.lit(False).alias("_old")).unionByName(alerts.select(*keys, F.col(ts), micros, F.lit(True).alias("_old")), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_micros").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_old"), F.col("_micros"))).over(before)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    recent = F.coalesce(known & (F.col("_last") >= F.col("_micros") - gap_micros), F.lit(False))
    return both.withColumn("_last", last).where(~F.col("_old") & ~recent).select(*candidates.columns)


def enqueue(outbox: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of the batch to insert: the first of each dedupe key that the outbox hasn't got."""
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(outbox.select(key), key, "left_anti")


def claimable(now: Column) -> Column:
    due = (F.col("status") == "pending") & (F.coalesce(F.col("next_attempt_at"), now) <= now)
    return due | ((F.col("status") == "sending") & (F.col("lease_expires_at") <= now))


def claim(outbox: DataFrame, now: Column, owner: str, n: int, lease: str = "5 minutes") -> DataFrame:
    """The n oldest claimable rows, leased: sending, one attempt more."""
    took = outbox.where(claimable(now)).orderBy("created_at", "id").limit(n)
    return took.withColumns({"status": F.lit("sending"), "attempts": F.col("attempts") + 1, "lease_owner": F.lit(owner), "lease_expires_at": now + F.expr(f"interval {lease}")})


def settle(leased: DataFrame, now: Column, owner: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """New state of leased rows by their ``result`` (sent, retry, permanent); a foreign or expired lease is rejected."""
    live = (F.col("status") == "sending") & (F.col("lease_owner") == owner) & (F.col("lease_expires_at") > now)
    final = (F.col("result") == "permanent") | (F.col("attempts") >= max_attempts)
    state = F.when(~F.coalesce(live, F.lit(False)), "rejected").when(F.col("result") == "sent", "sent").when(final, "dead").otherwise("pending")
    delay = F.when(state == "pending", retry_delay(F.col("attempts"), F.col("id")))
    return leased.withColumn("new_status", state).withColumn("retry_seconds", delay)
