"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key ``-ln(u) / w``: an exponential variate whose rate is the document's
quality weight, so taking documents by ascending key is weighted sampling without replacement.
Within a source keys are sorted and sizes prefix-summed up to the token budget. Whole epochs come
first; only what is left of the target is selected by key.

No source is sorted in one task. A histogram of its weights (at most ``WEIGHT_BINS`` + 1 bins, which merge by
addition) gives the share of its documents with a key below x, ``sum of shares * (1 - exp(-w x))``; cutting
that share evenly gives ordered buckets of about ``BUCKET_ROWS`` documents whatever the weights are. Only
the inside of a bucket is sorted; sums over buckets, and the order of the sources, are running sums over
ranges.

Nulls: a null source is a source of its own, the last one; null text has size 0 and is never taken;
a null doc_id draws the key of the empty id. Rows that repeat a doc_id are ordered by key and size; each
is taken as the plan says for that row. An empty table gives no rows. Other columns of the input, whatever
their names, are carried along by ``mix`` and left out by ``mix_plan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_names, own_columns, read_table, running_sums, stage_table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
BUCKET_ROWS = 1_000
LEAST_QUALITY = 0.05
#: Steps of the histogram of a source's weights, even in their logarithm.
WEIGHT_BINS = 32


def quality_weight(text: Column) -> Column:
    """Share of letters among the characters, at least 0.05: the rate of the document's key."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.greatest(F.lit(LEAST_QUALITY), letters / F.nullif(F.length(text), F.lit(0))), F.lit(LEAST_QUALITY))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """``-ln(u) / weight`` with u from the first 52 bits of an md5, the same on every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10)
    return -F.log((bits.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / weight


def document_facts(docs: DataFrame) -> list[Column]:
    """size, weight and key of a document: what the plan needs of its text."""
    weight = quality_weight(F.col("text"))
    return [word_count(F.col("text")).alias("size"), weight.alias("weight"), sampling_key(F.col("doc_id"), weight).alias("key")]


def source_targets(facts: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source: source, source_size, n_docs, rank, earlier (size of the sources before it), target, bins.

    Weights repeat over the sources in code-point order. Resharing the excess of full sources until
    none is above its limit has a closed form: sources sorted by limit/weight fill up as long as that
    ratio is at most (total - limits so far) / (weights left). Both orders are running sums over ranges.
    """
    step = F.floor(-F.log("weight") * F.lit(WEIGHT_BINS / -math.log(LEAST_QUALITY)))
    binned = facts.groupBy("source", step.alias("step")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w"))
    sized = binned.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"), F.collect_list(F.struct("n", "w")).alias("bins")).withColumn("one", F.lit(1))
    ranked = running_sums(sized, [F.col("source").asc_nulls_last()], ["one", "source_size"], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    weighed = (
        ranked.withColumnsRenamed({"one_before": "rank", "source_size_before": "earlier"})
        .withColumn("rank_weight", weight.cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("limit") / F.col("rank_weight"))
    )
    filled = stage_table(running_sums(weighed, [F.col("ratio"), F.col("rank")], ["limit", "rank_weight"], "mix-filled"), "mix-levels")
    whole = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("rank_weight"), F.lit(0.0)).alias("weight")).first()
    level = (F.lit(whole["size"] * share) - F.col("limit_before")) / (F.lit(whole["weight"]) - F.col("rank_weight_before"))
    levelled = filled.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    opened = levelled.where("not full").agg(F.min(F.struct("ratio", "rank", "level"))["level"]).first()[0]
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("rank_weight") * F.lit(opened).cast("double"))
    return levelled.select("source", "source_size", "n_docs", "rank", "earlier", target.alias("target"), "bins")


def placed_documents(facts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The facts with their source's targets and an ordered bucket of about ``bucket_rows`` documents of the source."""
    targets = stage_table(source_targets(facts), "mix-targets").withColumnRenamed("source", "_source")
    blocks = F.ceil(F.col("n_docs") / F.lit(bucket_rows))
    below = F.aggregate("bins", F.lit(0.0), lambda a, x: a + x["n"] * (1 - F.exp(-x["w"] * F.col("key")))) / F.col("n_docs")
    joined = facts.join(targets, facts["source"].eqNullSafe(F.col("_source")))
    return joined.withColumn("bucket", F.least(blocks - 1, F.floor(blocks * below))).drop("bins", "_source")


def planned(facts: DataFrame) -> DataFrame:
    """The facts with source_size, target and taken."""
    placed = placed_documents(facts)
    sums = stage_table(placed.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("earlier").alias("earlier")), "mix-buckets")
    starts = running_sums(sums, [F.col("rank"), F.col("bucket")], ["bucket_size"], "mix-starts").select(
        F.col("rank").alias("_rank"), F.col("bucket").alias("_bucket"), (F.col("bucket_size_before") - F.col("earlier")).alias("start")
    )
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        placed.join(starts, (F.col("rank") == F.col("_rank")) & (F.col("bucket") == F.col("_bucket")))
        .withColumn("before", F.col("start") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("epochs", epochs)
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("chosen", (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("budget")))
        .withColumn("taken", (F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))).cast("long"))
        .select(*own_columns(facts), "source_size", "target", "taken")
    )


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    facts = stage_table(docs.select("doc_id", "source", *document_facts(docs)), "mix-facts")
    return planned(facts).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents with the columns of ``docs``: each row as often as the mix takes it.

    Rows are staged under a number of their own, by which the plan finds them again; ids may be null or repeat.
    """
    row, facts, times, copy, taken = free_names(docs, "row", "facts", "times", "copy", "taken_row")
    staged = stage_table(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(facts, F.struct(*document_facts(docs))), "mix-rows")
    plan = planned(staged.select("doc_id", "source", F.col(row).alias("row"), f"{facts}.*")).where("taken > 0")
    plan = plan.select(F.col("row").alias(taken), (F.col("taken") / F.col("size")).cast("int").alias(times))
    return staged.join(plan, F.col(row) == F.col(taken)).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*own_columns(docs))


def op2_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_plan(read_table(spark, folder, "documents"))


#: SQL expressions of the size and the key, shared with the SQL of the pipeline.
SQL_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"
SQL_KEY = rf"""-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
    / coalesce(greatest({LEAST_QUALITY}::DOUBLE, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g'))::DOUBLE / nullif(length(text), 0)::DOUBLE), {LEAST_QUALITY}::DOUBLE)"""


def mix_sql(table: str) -> str:
    """DuckDB SQL with the rows of mix_plan over ``table``."""
    return f"""
WITH facts AS (SELECT doc_id, source, {SQL_SIZE} AS size, {SQL_KEY} AS key FROM {table}),
sized AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM facts GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3) + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim FROM sized),
levelled AS (SELECT *, lim / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
opened AS (SELECT *, first_value(level) OVER (ORDER BY ratio <= level, ratio, rank) AS open_level FROM levelled),
targets AS (SELECT source, source_size, CASE WHEN ratio <= level THEN lim ELSE weight * open_level END AS target FROM opened),
placed AS (SELECT f.doc_id, f.size, t.source_size, t.target,
    sum(f.size) OVER (PARTITION BY f.source ORDER BY f.key, f.doc_id, f.size ROWS UNBOUNDED PRECEDING) - f.size AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
    FROM facts f JOIN targets t ON f.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (size * (epochs + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""


QUERIES = {"op2_mix": op2_mix}
ORACLES = {"op2_mix": mix_sql("documents")}
