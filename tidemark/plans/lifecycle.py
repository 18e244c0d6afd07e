"""Deadlines and lifecycle queries over orders (registrations) and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators.blocks import final_states
from tidemark.operators.latest import latest
from tidemark.plans.base import SQL_TODAY, query, today

_REG = "CAST(o_orderdate AS DATE)"
_YEARS = "(year(DATE '2000-06-15') - year({d}))"
_RENEW = "CAST({d} + to_years(CAST(10 * (floor((2000 - year({d})) / 10.0) + CASE WHEN ((2000 - year({d})) % 10 + 10) % 10 = 0 THEN 0 ELSE 1 END) AS INT)) AS DATE)"


def _renew(d: str) -> str:
    return _RENEW.format(d=d)


@query("deadline_schedule", f"SELECT o_orderkey, u.t AS deadline_type, u.d AS due_date FROM (SELECT o_orderkey, unnest([{{'t': 'renewal', 'd': {_renew(_REG)}}}, {{'t': 'grace_period', 'd': CAST({_renew(_REG)} + INTERVAL 180 DAY AS DATE)}}]) AS u FROM orders)")
def deadline_schedule(read):
    """Renewal and grace period of each registration."""
    r = D.next_renewal(F.to_date("o_orderdate"), F.year(today()))
    both = F.array(F.struct(F.lit("renewal").alias("deadline_type"), r.alias("due_date")), F.struct(F.lit("grace_period").alias("deadline_type"), D.grace_end(r).alias("due_date")))
    return read("orders").select("o_orderkey", F.inline(both))


@query("opposition_due", f"SELECT o_orderkey, CAST({_REG} + to_days(CASE WHEN o_custkey % 3 = 0 THEN 60 ELSE 90 END) AS DATE) AS due_date, CAST({_REG} + INTERVAL 2 MONTH AS DATE) AS due_months, CAST({_REG} + 60 AS DATE) AS refusal_due FROM orders")
def opposition(read):
    """Opposition and refusal deadlines; every third customer files nationally."""
    d, office = F.to_date("o_orderdate"), F.when(F.col("o_custkey") % 3 == 0, "inpi").otherwise("EUIPO")
    return read("orders").select("o_orderkey", D.opposition_due(d, office).alias("due_date"), D.opposition_due_months(d).alias("due_months"), D.refusal_due(d).alias("refusal_due"))


@query("alert_schedule_explode", f"SELECT o_orderkey, alert_date FROM (SELECT o_orderkey, unnest([CAST({_renew(_REG)} - to_days(k) AS DATE) FOR k IN [180, 90, 30, 7, 1]]) AS alert_date FROM orders) WHERE alert_date >= {SQL_TODAY}")
def alert_schedule(read):
    """Alert dates that are not past."""
    due = D.next_renewal(F.to_date("o_orderdate"), F.year(today()))
    return read("orders").select("o_orderkey", F.explode(D.alert_schedule(due, today())).alias("alert_date"))


@query("renewal_windows", f"SELECT o_orderkey, {SQL_TODAY} BETWEEN CAST({_renew(_REG)} - INTERVAL 180 DAY AS DATE) AND {_renew(_REG)} AS window_open, ({SQL_TODAY} > {_renew(_REG)} AND {SQL_TODAY} <= CAST({_renew(_REG)} + INTERVAL 180 DAY AS DATE)) AS in_grace FROM orders")
def renewal_windows(read):
    """Whether the renewal window or the grace period is open."""
    d = F.to_date("o_orderdate")
    return read("orders").select("o_orderkey", D.renewal_window_open(d, today()).alias("window_open"), D.in_grace(d, today()).alias("in_grace"))


_EVENTS = "CASE event_type WHEN 'view' THEN 'renewal_due' WHEN 'click' THEN 'payment_received' WHEN 'purchase' THEN 'grace_period_started' WHEN 'signup' THEN 'grace_period_ended' WHEN 'error' THEN 'restoration_requested' ELSE 'provisional_refusal' END"
_STATES = " ".join(f"WHEN s || '|' || e = '{s}|{e}' THEN '{t}'" for (s, e), t in D.TRANSITIONS.items())


@query(
    "status_fsm_fold",
    f"""WITH ev AS (SELECT user_id, list({_EVENTS} ORDER BY ts, event_id) AS es FROM events GROUP BY user_id)
SELECT user_id, list_reduce(es, lambda s, e: CASE {_STATES} ELSE s END, 'active') AS status FROM ev""",
)
def status_fsm_fold(read):
    """A mark's state after its ordered events."""
    names = {"view": "renewal_due", "click": "payment_received", "purchase": "grace_period_started", "signup": "grace_period_ended", "error": "restoration_requested"}
    event = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("provisional_refusal"))
    rows = read("events").select("user_id", "ts", "event_id", event.alias("event"))
    return final_states(rows, ["user_id"], "event", ["ts", "event_id"], D.TRANSITIONS, "active")


@query(
    "deadline_recalculation",
    f"""WITH marks AS (SELECT o_orderkey, {_REG} AS reg, o_orderpriority AS src, o_custkey FROM orders),
allowed AS (SELECT * FROM marks WHERE src IS NULL OR lower(src) NOT IN ('5-low')),
pub AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS published FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey),
renewals AS (SELECT o_orderkey, 'renewal' AS deadline_type, {_renew('reg')} AS due_date FROM allowed UNION ALL SELECT o_orderkey, 'grace_period', CAST({_renew('reg')} + INTERVAL 180 DAY AS DATE) FROM allowed),
oppo AS (SELECT a.o_orderkey, 'opposition', CAST(published + to_days(CASE WHEN o_custkey % 3 = 0 THEN 60 ELSE 90 END) AS DATE) FROM allowed a JOIN pub ON l_orderkey = o_orderkey)
SELECT deadline_type, count(*) AS n, min(due_date) AS first_due, max(due_date) AS last_due FROM (SELECT * FROM renewals UNION ALL SELECT * FROM oppo) GROUP BY deadline_type""",
)
def deadline_recalculation(read):
    """Deny filter, renewal, grace and opposition deadlines of the latest publication."""
    denied = F.lower("o_orderpriority").isin("5-low")
    marks = read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("reg"), "o_orderpriority", "o_custkey").where(~F.coalesce(denied, F.lit(False)))
    pub = read("lineitem").where(F.col("l_linestatus") == "F").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("published"))
    r = D.next_renewal(F.col("reg"), F.year(today()))
    own = marks.select("o_orderkey", F.inline(F.array(F.struct(F.lit("renewal").alias("deadline_type"), r.alias("due_date")), F.struct(F.lit("grace_period").alias("deadline_type"), D.grace_end(r).alias("due_date")))))
    office = F.when(F.col("o_custkey") % 3 == 0, "INPI").otherwise("EUIPO")
    oppo = marks.join(pub, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.lit("opposition").alias("deadline_type"), D.opposition_due(F.col("published"), office).alias("due_date"))
    return own.unionByName(oppo).groupBy("deadline_type").agg(F.count(F.lit(1)).alias("n"), F.min("due_date").alias("first_due"), F.max("due_date").alias("last_due"))


@query(
    "pending_replacement",
    """WITH old AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'renewal' ELSE 'opposition' END AS kind, o_orderstatus AS status FROM orders),
new AS (SELECT o_orderkey, 'renewal' AS kind FROM orders WHERE o_custkey % 2 = 0)
SELECT kind, status, count(*) AS n FROM (SELECT kind, status FROM old o WHERE NOT (status = 'O' AND EXISTS (SELECT 1 FROM new n WHERE n.o_orderkey = o.o_orderkey AND n.kind = o.kind)) UNION ALL SELECT kind, 'O' FROM new) GROUP BY kind, status""",
)
def pending_replacement(read):
    """Pending deadlines of a type are replaced, the others stay."""
    orders = read("orders")
    old = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "renewal").otherwise("opposition").alias("kind"), F.col("o_orderstatus").alias("status"))
    new = orders.where("o_custkey % 2 = 0").select("o_orderkey", F.lit("renewal").alias("kind"))
    gone = new.withColumn("status", F.lit("O"))
    kept = old.join(gone, ["o_orderkey", "kind", "status"], "left_anti")
    return kept.unionByName(gone).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "expiry_scan",
    f"""WITH due AS (SELECT o_orderkey, o_custkey, {_renew(_REG)} AS due_date FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, c_name, due_date, datediff('day', {SQL_TODAY}, due_date)::INT AS days_remaining FROM due JOIN customer ON c_custkey = o_custkey WHERE due_date BETWEEN {SQL_TODAY} AND CAST({SQL_TODAY} + INTERVAL 30 DAY AS DATE)""",
)
def expiry_scan(read):
    """Pending deadlines of the next 30 days with their owner."""
    due = read("orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", D.next_renewal(F.to_date("o_orderdate"), F.year(today())).alias("due_date"))
    soon = due.where(F.col("due_date").between(today(), F.date_add(today(), 30)))
    return soon.join(read("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "due_date", F.date_diff("due_date", today()).alias("days_remaining"))


@query(
    "owned_deadlines_semi",
    f"SELECT o_orderkey, {_REG} AS due_date FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') ORDER BY due_date, o_orderkey",
)
def owned_deadlines(read):
    """Deadlines of marks that the user's alerts name, by due date."""
    named = read("events").where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    return read("orders").join(named, "o_custkey", "left_semi").select("o_orderkey", F.to_date("o_orderdate").alias("due_date")).orderBy("due_date", "o_orderkey")


@query(
    "latest_publication",
    "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS published FROM lineitem WHERE lower(l_returnflag) NOT IN ('r') QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber) = 1",
)
def latest_publication(read):
    """The latest allowed publication of each mark."""
    allowed = read("lineitem").where(~F.lower("l_returnflag").isin("r"))
    return latest(allowed, ["l_orderkey"], [F.desc("l_shipdate"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("published"))


@query("month_partitions", "SELECT date_trunc('month', o_orderdate)::DATE AS month_start, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS month_end, strftime(o_orderdate, '%Y_%m') AS suffix, count(*) AS n, sum(length(o_orderpriority))::BIGINT AS size_chars FROM orders GROUP BY ALL")
def month_partitions(read):
    """Monthly partitions with their bounds and sizes."""
    m = D.month_bounds(F.to_date("o_orderdate"))
    return read("orders").groupBy(m["start"].alias("month_start"), m["end"].alias("month_end"), m["suffix"].alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("o_orderpriority")).alias("size_chars"))


@query(
    "missing_weekdays",
    "SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def missing_weekdays(read):
    """Working days without a bulletin."""
    from pyspark.sql import SparkSession

    days = SparkSession.active().range(1).select(F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).alias("day"))
    seen = read("orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day"))
    return days.where(F.weekday("day") < 5).join(seen, "day", "left_anti")


@query(
    "status_event_link",
    """SELECT o_orderkey, l_linenumber, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))::INT AS gap FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND abs(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 7""",
)
def status_event_link(read):
    """Events within seven days of a state change of the same process."""
    gap = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return read("orders").join(read("lineitem"), (F.col("o_orderkey") == F.col("l_orderkey")) & (F.abs(gap) <= 7)).select("o_orderkey", "l_linenumber", gap.alias("gap"))


@query(
    "drift_moving_average",
    """WITH daily AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean FROM daily)
SELECT day, event_type, n, round(mean, 6) AS mean, coalesce(n < 0.5 * mean, false) AS dropped FROM m""",
)
def drift_moving_average(read):
    """Drops against the moving average of the last 20 days."""
    daily = read("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("event_type").orderBy("day").rowsBetween(-20, -1)
    mean = F.avg("n").over(before)
    return daily.withColumn("m", mean).select("day", "event_type", "n", F.round("m", 6).alias("mean"), F.coalesce(F.col("n") < F.col("m") * 0.5, F.lit(False)).alias("dropped"))
