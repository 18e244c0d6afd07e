"""Registry date arithmetic. Whatever depends on today takes it as a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALERT_DAYS = (180, 90, 30, 7, 1)
GRACE_DAYS = 180


def iso_date(text: Column) -> Column:
    """The date of the first ten characters (yyyy-MM-dd); null if they are none."""
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def iso_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def next_renewal(registered: Column, year: Column) -> Column:
    """The ten-year anniversary at or after the reference year; 29 February falls on the 28th where there is none."""
    elapsed = year - F.year(registered)
    cycle = F.floor(elapsed / 10) + F.when(F.pmod(elapsed, F.lit(10)) == 0, 0).otherwise(1)
    return F.add_months(registered, (cycle * 120).cast("int"))


def grace_end(renewal: Column) -> Column:
    return F.date_add(renewal, GRACE_DAYS)


def opposition_due(published: Column, jurisdiction: Column) -> Column:
    """60 days for the national office, 90 for others."""
    return F.date_add(published, F.when(F.upper(jurisdiction).isin("INPI", "PT"), 60).otherwise(90))


def opposition_due_months(published: Column) -> Column:
    """The two calendar months that ingestion uses."""
    return F.add_months(published, 2)


def refusal_due(refused: Column, days: int = 60) -> Column:
    return F.date_add(refused, days)


def alert_schedule(due: Column, today: Column, days: tuple[int, ...] = ALERT_DAYS) -> Column:
    """Alert dates before ``due`` that are not past, ascending."""
    every = F.array(*[F.date_sub(due, k) for k in days])
    return F.array_sort(F.filter(every, lambda d: d >= today))


def renewal_window_open(registered: Column, today: Column) -> Column:
    r = next_renewal(registered, F.year(today))
    return today.between(F.date_sub(r, 180), r)


def in_grace(registered: Column, today: Column) -> Column:
    r = next_renewal(registered, F.year(today))
    return (today > r) & (today <= grace_end(r))


def month_bounds(day: Column) -> Column:
    """Struct of the half-open month (start, end) and its suffix yyyy_MM."""
    start = F.trunc(day, "month")
    return F.struct(start.alias("start"), F.add_months(start, 1).alias("end"), F.date_format(day, "yyyy_MM").alias("suffix"))


#: Fixed values: (state, event) -> next state of a mark.
TRANSITIONS = {
    ("active", "renewal_due"): "renewal_period",
    ("renewal_period", "payment_received"): "active",
    ("renewal_period", "grace_period_started"): "grace_period",
    ("grace_period", "payment_received"): "active",
    ("grace_period", "grace_period_ended"): "lapsed",
    ("lapsed", "restoration_requested"): "recoverable",
    ("recoverable", "restoration_granted"): "active",
    ("recoverable", "restoration_denied"): "dead",
    ("lapsed", "restoration_window_closed"): "dead",
    ("active", "provisional_refusal"): "refused",
    ("refused", "response_accepted"): "active",
    ("refused", "response_rejected"): "dead",
}


def next_status(status: Column, event: Column) -> Column:
    """The state after the event; an unknown pair leaves the (lower-cased) state."""
    state = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    table = F.create_map(*[F.lit(x) for (s, e), t in TRANSITIONS.items() for x in (f"{s}|{e}", t)])
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", state, F.lower(F.trim(event)))), state)


def retry_delay(attempt: Column, key: Column) -> Column:
    """Seconds to the next try: 2^attempt up to an hour, and a jitter that the row fixes."""
    return F.least(F.lit(3600.0), F.pow(F.lit(2.0), F.least(attempt, F.lit(10))) + F.conv(F.substring(F.md5(F.concat_ws(":", attempt.cast("string"), key.cast("string"))), 1, 6), 16, 10).cast("long") % 31)
