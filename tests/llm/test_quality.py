"""Fences follow the spread of their group; the filter measures each text once."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality


def docs_of(spark, spread, source, n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = 6 + spread * (i % 5)
        rows.append((i, " ".join("".join(rng.choice(list("abcdefgh"), size)) for _ in range(60)), "en", source))
    return rows


def test_fences_follow_the_spread(spark):
    """The same long-worded texts pass in the source that varies and fail in the one that doesn't."""
    tall = [(1000 + k, " ".join(f"{'q' * 13}{j:02d}" for j in range(60)), "en", s) for k, s in enumerate(("wide", "narrow"))]
    docs = spark.createDataFrame(docs_of(spark, 2, "wide") + docs_of(spark, 0, "narrow", seed=1) + tall, "doc_id long, text string, lang string, source string")
    kept = {(r.doc_id, r.kept) for r in quality.quality_verdicts(docs).where("doc_id >= 1000").collect()}
    assert kept == {(1000, True), (1001, False)}
    limits = {r.source: r.quartiles for r in quality.quartile_table(quality_facts(docs)).collect()}
    assert limits["wide"].word_length.q75 - limits["wide"].word_length.q25 > 300 > 5 > limits["narrow"].word_length.q75 - limits["narrow"].word_length.q25


def quality_facts(docs):
    return docs.select("lang", "source", quality.text_metrics(F.col("text")).alias("m")).select("lang", "source", "m.*")


def test_small_groups_use_merged_sketches(spark):
    rows = docs_of(spark, 1, "big") + [(5000, docs_of(spark, 1, "x", 1)[0][1], "en", "tiny"), (5001, docs_of(spark, 1, "x", 1)[0][1], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {(r.lang, r.source): r.quartiles for r in quality.quartile_table(quality_facts(docs)).collect()}
    assert limits["en", "tiny"].word_length.q25 == limits["en", "big"].word_length.q25 and limits[None, None] is not None


def test_filter_equals_verdicts_and_measures_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"counts": F.lit(1), "group_lang": F.lit("x"), "_m": F.lit(2), "_source": F.lit(3)})
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and len(want) > 100
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "regexp" not in plan


def test_symbol_fences_differ_between_sources(spark):
    """The same share of symbols passes in a source of short texts with many and fails in one of long texts without."""
    words = lambda n: " ".join(f"word{j:03d}" for j in range(n))
    noisy = [(k, words(30 + k % 9) + " #" * (k % 4), "en", "noisy") for k in range(100)]
    clean = [(200 + k, words(300 + 5 * k), "en", "clean") for k in range(100)]
    same = [(1000 + k, words(40) + " # #", "en", s) for k, s in enumerate(("noisy", "clean"))]
    docs = spark.createDataFrame([*noisy, *clean, *same, (1002, words(21), "en", "clean")], "doc_id long, text string, lang string, source string")
    limits = {r.source: r.quartiles.symbol_share for r in quality.quartile_table(quality_facts(docs)).collect()}
    assert all(q.q75 > q.q25 for q in limits.values()) and limits["noisy"].q75 > limits["clean"].q75
    within = quality.quality_verdicts(docs).where("doc_id >= 1000")
    assert {(r.doc_id, r.kept) for r in within.collect()} == {(1000, True), (1001, False), (1002, True)}
