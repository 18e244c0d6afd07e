"""Reconciliation of sources: fields by priority with their conflicts, and events with marks by a ladder of evidence."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import trigrams
from tidemark.operators.matching import gram_pairs
from tidemark.sources.staging import staged

#: Rank of a source that the priority table doesn't know for a field.
LAST = 1 << 30


def field_values(sources: dict[str, DataFrame], key: str, fields: list[str]) -> DataFrame:
    """key, field, value, source: the fields of all sources in rows, as text; nulls are left out."""
    out = None
    for name, df in sources.items():
        rows = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(key, fields, "field", "value").where("value is not null").withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def resolved_fields(values: DataFrame, key: str, priorities: DataFrame) -> DataFrame:
    """key, field, value, source, n_values, resolution, others of every field that a source has.

    priorities: field, source, rank and policy (of the field: ``prefer`` or ``preserve_both``). The value of the least rank is
    chosen, of one source the least value. Where sources differ, ``others`` holds what wasn't chosen and the
    resolution is ``review_required`` if the policy keeps both, else ``resolved_by_priority``; ``agreed`` otherwise. One
    shuffle; a group holds the distinct values of one field of one record.
    """
    ranks = priorities.select(F.col("field").alias("_field"), F.col("source").alias("_source"), "rank")
    policies = priorities.groupBy(F.col("field").alias("_of")).agg(F.max("policy").alias("policy"))
    ranked = values.join(ranks, (F.col("field") == F.col("_field")) & (F.col("source") == F.col("_source")), "left")
    every = F.array_sort(F.collect_set(F.struct(F.coalesce("rank", F.lit(LAST)).alias("rank"), "source", "value")))
    grouped = ranked.groupBy(key, "field").agg(every.alias("every")).join(policies, F.col("field") == F.col("_of"), "left")
    best = F.get("every", F.lit(0))
    others = F.filter("every", lambda x: x["value"] != best["value"])
    resolution = F.when(F.size(others) == 0, "agreed").when(F.col("policy") == "preserve_both", "review_required").otherwise("resolved_by_priority")
    return grouped.select(
        key, "field", best["value"].alias("value"), best["source"].alias("source"), F.size(F.array_distinct(F.transform("every", lambda x: x["value"]))).alias("n_values"), resolution.alias("resolution"),
        F.transform(others, lambda x: F.struct(x["source"].alias("source"), x["value"].alias("value"))).alias("others"),
    )


def conflict_rows(resolved: DataFrame, key: str) -> DataFrame:
    """One row per value that wasn't chosen: key, field, chosen, chosen_source, source, value, resolution."""
    rows = resolved.select(key, "field", F.col("value").alias("chosen"), F.col("source").alias("chosen_source"), "resolution", F.explode("others").alias("o"))
    return rows.select(key, "field", "chosen", "chosen_source", F.col("o.source").alias("source"), F.col("o.value").alias("value"), "resolution")


def reconciled(events: DataFrame, marks: DataFrame, least: float = 0.6) -> DataFrame:
    """The events, each once, with strength, mark (number) and score of the strongest evidence.

    events: number, name, date, block and any other columns; marks: number, name, date, block. Rungs:

    * ``strong``: the number is a mark's;
    * ``medium``: name and date are a mark's;
    * ``weak``: in the block, a mark's name has a trigram Jaccard of ``least`` or more; the nearest name, of equal ones the least;
    * ``none``.

    Of several marks the least number is taken. What a rung is joined with has one row per key, so events never
    multiply; only distinct names that no stronger rung has found are compared, and trigrams carry their block, so
    a pair of names meets only over a rare trigram of the block.
    """
    strong = marks.where("number is not null").select(F.col("number").alias("_strong")).distinct()
    medium = marks.groupBy(F.col("name").alias("_name"), F.col("date").alias("_date")).agg(F.min("number").alias("_medium"))
    rungs = _left(_left(events, strong, {"number": "_strong"}), medium, {"name": "_name", "date": "_date"}).drop("_name", "_date")
    held = staged(rungs, "rungs")
    texts = lambda df: df.select(_in_block().alias("t"), "block", "name").where("t is not null").distinct()
    grams = lambda df: df.select("t", F.transform(trigrams(F.col("name")), lambda g: F.concat_ws("\x1f", F.col("block").cast("string"), g)).alias("gs"))
    asked = texts(held.where("_strong is null and _medium is null"))
    near = gram_pairs(grams(asked), grams(texts(marks)), least, strict=False)
    ids = marks.groupBy(_in_block().alias("_b")).agg(F.min("number").alias("number"))
    best = near.groupBy("a").agg(F.max_by("b", F.struct("trgm", _descending("b"))).alias("b"), F.max("trgm").alias("_score"))
    weak = best.join(ids, F.col("b") == F.col("_b")).select(F.col("a").alias("_t"), F.col("number").alias("_weak"), "_score")
    open_ = F.when(F.col("_strong").isNull() & F.col("_medium").isNull(), _in_block())
    found = _left(held.withColumn("_open", open_), weak, {"_open": "_t"})
    strength = F.when(F.col("_strong").isNotNull(), "strong").when(F.col("_medium").isNotNull(), "medium").when(F.col("_weak").isNotNull(), "weak").otherwise("none")
    score = F.when(F.col("_strong").isNotNull() | F.col("_medium").isNotNull(), 1.0).otherwise(F.col("_score"))
    return found.select(*[F.col(f"`{c}`") for c in events.columns], strength.alias("strength"), F.coalesce("_strong", "_medium", "_weak").alias("mark"), score.alias("score"))


def _left(rows: DataFrame, found: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The rows left joined with ``found`` on keys (column of rows: column of found); rows without a key, which find nothing, are dealt by all they hold, not to one task."""
    kinds = dict(found.dtypes)
    own = F.xxhash64(*[F.col(a).cast(kinds[b]) for a, b in keys.items()])
    absent = reduce(or_, [F.col(a).isNull() for a in keys])
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"])  # those have no hash
    left = rows.withColumn("_dealt", F.when(absent, whole).otherwise(own))
    right = found.withColumn("_at", F.xxhash64(*keys.values()))
    return left.join(right, reduce(and_, [F.col("_dealt") == F.col("_at"), *[F.col(a) == F.col(b) for a, b in keys.items()]]), "left").drop("_dealt", "_at")


def _in_block() -> Column:
    return F.when(F.col("name").isNotNull() & F.col("block").isNotNull(), F.concat_ws("\x1f", F.col("block").cast("string"), "name"))


def _descending(text: str) -> Column:
    """A key that is the larger the smaller the text is, character by character; a beginning is larger than what it begins."""
    return F.concat(F.transform(F.split(text, ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))
