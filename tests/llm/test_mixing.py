"""Buckets of the mix stay near their size whatever the weights; rows of one id or none are taken as planned."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.common import stage_table


def test_buckets_follow_the_weights(spark):
    """Sources of weight 0.05, of 0.5 and of a mixture: no window outgrows the others."""
    weight = F.when(F.col("source") == "low", 0.05).when(F.col("source") == "mid", 0.5).otherwise(F.greatest(F.lit(0.05), F.pmod("id", F.lit(97)) / 97))
    rows = spark.range(30_000).withColumn("source", F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("any")), (F.col("id") % 3 + 1).cast("int"))).withColumn("weight", weight)
    facts = stage_table(rows.select(F.col("id").alias("doc_id"), "source", F.lit(3).cast("long").alias("size"), "weight", mixing.sampling_key(F.col("id"), F.col("weight")).alias("key")), "test-facts")
    placed = mixing.placed_documents(facts, 100)
    counts = placed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    assert len(counts) == 300 and max(r.n for r in counts) < 160 and min(r.n for r in counts) > 50
    for source in ("low", "mid", "any"):
        own = sorted((r for r in counts if r.source == source), key=lambda r: r.bucket)
        assert all(a.high <= b.low for a, b in zip(own, own[1:], strict=False))


def test_repeated_and_null_ids_are_mixed(spark):
    rows = [(None, "one two three", "a", 1), (None, "four five", "a", 2), (7, "six", "a", 3), (7, "seven eight nine ten", "a", 4), (8, None, "b", 5), (9, "", "b", 6), (10, "x " * 50, "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    plan = mixing.mix_plan(docs)
    want = plan.agg(F.sum("taken")).first()[0]
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert sum(len((r.text or "").split()) for r in out) == want > 0
    times = Counter(r.row for r in out)
    assert max(times.values()) <= 2 and not {5, 6} & set(times)
    assert mixing.mix(docs.limit(0)).count() == 0
