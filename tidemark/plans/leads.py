"""Prospection and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.latest import latest
from tidemark.plans.base import SQL_TODAY, query, today
from tidemark.sources.export import opportunity_columns

# Parts of a name that suggest a company.
COMPANY = ("lda", "l.d.a", "s.a", "sa", "unipessoal", "limitada", "sociedade")
COMPANY_PATTERN = "|".join(c.replace(".", "\\.") for c in COMPANY)


def looks_like_company(name):
    return F.lower(name).rlike(COMPANY_PATTERN)


_SQL_MARKS = """marks AS (SELECT o_orderkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' Lda' WHEN c_custkey % 3 = 1 THEN ' Salgado' ELSE ' KG' END AS owner, CASE o_orderstatus WHEN 'O' THEN 'REGISTERED' WHEN 'F' THEN 'EXPIRED' ELSE 'PENDING' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'RENEWED' ELSE 'DUE' END AS renewal_status, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN [] ELSE [c_name] END AS reps,
    CAST(o_orderdate + INTERVAL 2 YEAR AS DATE) AS expiry_date, CAST(o_orderdate AS DATE) AS application_date, [o_custkey % 45 + 1, o_orderkey % 45 + 1] AS classes, lower(c_mktsegment) AS district FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _marks(read):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    joined = read("orders").join(read("customer"), F.col("o_custkey") == c)
    owner = F.concat("c_name", F.when(c % 3 == 0, " Lda").when(c % 3 == 1, " Salgado").otherwise(" KG"))
    status = F.when(F.col("o_orderstatus") == "O", "REGISTERED").when(F.col("o_orderstatus") == "F", "EXPIRED").otherwise("PENDING")
    reps = F.when(k % 4 == 0, None).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array("c_name"))
    return joined.select(
        "o_orderkey", owner.alias("owner"), status.alias("status"), F.when(k % 5 == 0, None).when(k % 5 == 1, "RENEWED").otherwise("DUE").alias("renewal_status"), reps.alias("reps"),
        F.to_date(F.add_months("o_orderdate", 24)).alias("expiry_date"), F.to_date("o_orderdate").alias("application_date"), F.array(c % 45 + 1, k % 45 + 1).alias("classes"), F.lower("c_mktsegment").alias("district"),
    )


def _unrepresented():
    return F.col("reps").isNull() | (F.size("reps") == 0)


def expiring(marks):
    return marks.where(F.col("status").isin("REGISTERED", "PENDING", "ACTIVE") & (F.col("renewal_status") != "RENEWED") & F.col("expiry_date").between(today(), F.date_add(today(), 180)) & _unrepresented())


def new_filings(marks):
    return marks.where((F.col("application_date") >= F.date_sub(today(), 30)) & (F.col("application_date") <= today()) & _unrepresented())


def lapsed_companies(marks):
    return marks.where(F.col("status").isin("EXPIRED", "LAPSED") & (F.col("expiry_date") >= F.date_sub(today(), 90)) & (F.col("expiry_date") <= today()) & looks_like_company(F.col("owner")))


_EXPIRING = f"SELECT o_orderkey, owner, expiry_date FROM marks WHERE status IN ('REGISTERED', 'PENDING', 'ACTIVE') AND renewal_status <> 'RENEWED' AND expiry_date BETWEEN {SQL_TODAY} AND CAST({SQL_TODAY} + 180 AS DATE) AND (reps IS NULL OR len(reps) = 0)"
_NEW = f"SELECT o_orderkey, owner, expiry_date FROM marks WHERE application_date >= CAST({SQL_TODAY} - 30 AS DATE) AND application_date <= {SQL_TODAY} AND (reps IS NULL OR len(reps) = 0)"
_LAPSED = f"SELECT o_orderkey, owner, expiry_date FROM marks WHERE status IN ('EXPIRED', 'LAPSED') AND expiry_date >= CAST({SQL_TODAY} - 90 AS DATE) AND expiry_date <= {SQL_TODAY} AND regexp_matches(lower(owner), '{COMPANY_PATTERN}')"


def _lead(rows):
    return rows.select("o_orderkey", "owner", "expiry_date")


@query("leads_expiring", f"WITH {_SQL_MARKS} {_EXPIRING}")
def leads_expiring(read):
    """Marks that expire soon and have no representative."""
    return _lead(expiring(_marks(read)))


@query("leads_new", f"WITH {_SQL_MARKS} {_NEW}")
def leads_new(read):
    """Recent filings without an agent."""
    return _lead(new_filings(_marks(read)))


@query("leads_lapsed", f"WITH {_SQL_MARKS} {_LAPSED}")
def leads_lapsed(read):
    """Recently lapsed marks of companies."""
    return _lead(lapsed_companies(_marks(read)))


@query("leads_union", f"WITH {_SQL_MARKS} SELECT 'expiring_no_representative' AS opportunity_type, * FROM ({_EXPIRING}) UNION ALL SELECT 'new_filing_without_agent', * FROM ({_NEW}) UNION ALL SELECT 'recently_expired_company', * FROM ({_LAPSED})")
def leads_union(read):
    """The three lists, tagged."""
    m = _marks(read)
    kinds = {"expiring_no_representative": expiring(m), "new_filing_without_agent": new_filings(m), "recently_expired_company": lapsed_companies(m)}
    parts = [_lead(rows).withColumn("opportunity_type", F.lit(k)) for k, rows in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("leads_csv_rows", f"WITH {_SQL_MARKS} SELECT CAST(o_orderkey AS VARCHAR) AS trademark, owner, coalesce(reps[1], '') AS representative, CAST(expiry_date AS VARCHAR) AS expiry_date, array_to_string(classes, ',') AS nice_classes, 'all' AS opportunity_type, coalesce(district, '') AS district FROM marks WHERE list_contains(classes, 9) AND district = 'building'")
def leads_csv_rows(read):
    """Rows of the CSV export, filtered by class and district."""
    rows = _marks(read).where(F.array_contains("classes", F.lit(9).cast("bigint")) & (F.lower(F.coalesce("district", F.lit(""))) == "building"))
    return opportunity_columns(rows.select(F.col("o_orderkey").cast("string").alias("word_mark"), "owner", F.get("reps", F.lit(0)).alias("representative"), F.col("expiry_date").cast("string").alias("expiry_date"), F.col("classes").alias("nice_classes"), F.lit("all").alias("opportunity_type"), "district"))


@query("company_name_flag", "SELECT s_suppkey, regexp_matches(lower(s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' S.A.' ELSE ' GmbH' END), 'lda|l\\.d\\.a|s\\.a|sa|unipessoal|limitada|sociedade') AS company FROM supplier")
def company_name_flag(read):
    """P17."""
    return read("supplier").select("s_suppkey", looks_like_company(F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " S.A.").otherwise(" GmbH"))).alias("company"))


@query(
    "quality_runs",
    "SELECT o_orderpriority AS source, count(*) AS runs, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS failed, coalesce(sum(o_custkey), 0)::BIGINT AS records, round(avg(o_totalprice), 4) AS mean_value FROM orders GROUP BY 1",
)
def quality_runs(read):
    """Run counters of every source in one pass."""
    return read("orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("failed"), F.coalesce(F.sum("o_custkey"), F.lit(0)).alias("records"), F.round(F.avg("o_totalprice"), 4).alias("mean_value"))


@query("latest_run_per_source", "SELECT o_orderpriority AS source, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_run(read):
    """The last run of each source."""
    return latest(read("orders"), ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_orderpriority").alias("source"), "o_orderkey", "o_orderdate")


@query("completeness_counts", "SELECT count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS no_text, count(*) FILTER (lang IS NULL) AS no_lang, count(*) FILTER (source IS NULL) AS no_source, count(*) FILTER (n_chars < 200) AS short FROM documents")
def completeness(read):
    """Empty fields of a table in one scan."""
    d = read("documents")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("no_text"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("source").isNull()).alias("no_source"), F.count_if(F.col("n_chars") < 200).alias("short"))


@query(
    "quality_report",
    "SELECT o_orderpriority AS source, count(*) AS runs, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE / count(*) AS failed_share, max(o_orderdate) AS last_run, count(DISTINCT o_custkey) AS parties FROM orders GROUP BY 1",
)
def quality_report(read):
    """The report's figures in one job."""
    return read("orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("runs"), (F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("failed_share"), F.max("o_orderdate").alias("last_run"), F.countDistinct("o_custkey").alias("parties"))


@query("watchlist_totals", "SELECT c_nationkey, count(*) AS items, count(DISTINCT c_mktsegment) AS lists FROM customer GROUP BY 1")
def watchlist_totals(read):
    """Items of each watchlist."""
    return read("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("c_mktsegment").alias("lists"))


@query(
    "plan_quota",
    "SELECT c_custkey, coalesce(map {'BUILDING': 'pro', 'MACHINERY': 'team'}[c_mktsegment], 'free') AS plan, count(o_orderkey) AS marks, count(o_orderkey) < coalesce(map {'BUILDING': 50, 'MACHINERY': 500}[c_mktsegment], 5) AS may_add FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment",
)
def plan_quota(read):
    """The plan of each account (default free) and its quota."""
    plans = F.create_map(*[F.lit(x) for x in ("BUILDING", "pro", "MACHINERY", "team")])
    most = F.create_map(F.lit("BUILDING"), F.lit(50), F.lit("MACHINERY"), F.lit(500))
    counts = read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("m"))
    marks = F.coalesce("m", F.lit(0))
    return read("customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce(F.try_element_at(plans, F.col("c_mktsegment")), F.lit("free")).alias("plan"), marks.alias("marks"), (marks < F.coalesce(F.try_element_at(most, F.col("c_mktsegment")), F.lit(5))).alias("may_add"))
