"""Fuzzy matching of marks: an exact trigram join, scores and top-k.

A pair with Jaccard t or more of n trigrams shares one of the n - ceil(t n) + 1 rarest of either side, so
only those rarest trigrams are joined (prefix filter), as places in the common order, not with their texts. The place of a pair's
first common trigram bounds how many can follow (position filter); only pairs that may still reach t are compared, once. Texts are
matched once, however many rows have them. At a low t, where most trigrams are among the rarest, the join makes
as many rows as there are shared rare trigrams; figures are in the README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.similarity import class_overlap, composite_score, jaccard, pt_phonetic_similarity, text_similarity
from tidemark.functions.text import trigrams


def _trigram_texts(texts: DataFrame) -> DataFrame:
    """Distinct texts t with their trigrams gs, computed once."""
    return texts.select("t").where("t is not null").distinct().select("t", trigrams(F.col("t")).alias("gs"))


def _rarest(texts: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """(t, n, g, place) for the rarest trigrams of each text, as many as the prefix filter needs."""
    each = texts.select("t", F.size("gs").alias("n"), F.explode("gs").alias("g")).join(frequency, "g", "left")
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy(F.coalesce("f", F.lit(0)), "g")))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("t", "n", "g", "place")


def candidate_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b) of the texts (t, gs) of both sides that the filters by rarest trigrams, numbers and places leave."""
    frequency = right.select(F.explode("gs").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    a = _rarest(left, frequency, least).toDF("a", "na", "g", "i")
    b = _rarest(right, frequency, least).toDF("b", "nb", "g", "j")
    sized = a.join(b, "g").where(F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)
    first = sized.groupBy("a", "b").agg(F.min(F.struct("i", "j")).alias("p"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    most = 1 + F.least(F.col("na") - F.col("p.i"), F.col("nb") - F.col("p.j"))
    return first.where(most >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9).select("a", "b")


def gram_pairs(left: DataFrame, right: DataFrame, least: float, strict: bool = True) -> DataFrame:
    """(a, b, trgm) of the texts (t, gs) of both sides whose Jaccard is above (or at) ``least`` > 0."""
    pairs = candidate_pairs(left, right, least)
    met = pairs.join(left.select(F.col("t").alias("a"), F.col("gs").alias("ga")), "a").join(right.select(F.col("t").alias("b"), F.col("gs").alias("gb")), "b")
    scored = met.select("a", "b", jaccard(F.col("ga"), F.col("gb")).alias("trgm"))
    return scored.where(F.col("trgm") > least if strict else F.col("trgm") >= least)


def trigram_pairs(left: DataFrame, right: DataFrame, least: float, strict: bool = True) -> DataFrame:
    """(a, b, trgm) of the texts t of both sides whose trigram Jaccard is above (or at) ``least`` > 0."""
    return gram_pairs(_trigram_texts(left), _trigram_texts(right), least, strict)


def similar_marks(items: DataFrame, marks: DataFrame, threshold: int = 40, limit: int = 5, prefilter: int = 3, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), extra_phonetic=None) -> DataFrame:
    """The best marks for each watched item.

    items, marks: id, text, classes. Candidates have trigram similarity above max(0.1, threshold / 200);
    the best ``prefilter * limit`` of an item by trigram (ties: id) are scored, and those at ``threshold``
    or more are ranked. Of a text's rows those beyond the first ``prefilter * limit + 1`` ids can't be among them;
    the one more stands in for the item's own id, which may be among the first.
    """
    keep = prefilter * limit
    pairs = trigram_pairs(items.select(F.col("text").alias("t")), marks.select(F.col("text").alias("t")), max(0.1, threshold / 200.0))
    first = Window.partitionBy("text").orderBy("id")
    rows = marks.where("id is not null").withColumn("k", F.row_number().over(first)).where(F.col("k") <= keep + 1).select(F.col("id").alias("mark_id"), F.col("text").alias("b"), F.col("classes").alias("mark_classes"))
    asked = items.select(F.col("id").alias("item_id"), F.col("text").alias("a"), F.col("classes").alias("item_classes"))
    by_trigram = Window.partitionBy("item_id").orderBy(F.desc("trgm"), "mark_id")
    # Texts whose better ones have more rows than the top can hold are left out before ids are joined; equal ones stay together.
    sized = pairs.join(rows.groupBy("b").agg(F.count(F.lit(1)).alias("rows")), "b")
    upto, equal = Window.partitionBy("a").orderBy(F.desc("trgm")), Window.partitionBy("a", "trgm")
    near = sized.withColumn("better", F.sum("rows").over(upto) - F.sum("rows").over(equal)).where(F.col("better") <= keep).select("a", "b", "trgm")
    candidates = asked.join(near, "a").join(rows, "b").where("item_id <> mark_id").withColumn("pos", F.row_number().over(by_trigram)).where(F.col("pos") <= keep)
    phonetic = pt_phonetic_similarity(F.col("a"), F.col("b"))
    if extra_phonetic is not None:
        phonetic = F.greatest(phonetic, extra_phonetic(F.col("a"), F.col("b")))
    scored = candidates.select("item_id", "mark_id", "a", "b", "pos", "trgm", text_similarity(F.col("a"), F.col("b")).alias("text_score"), phonetic.alias("phonetic_score"), class_overlap(F.col("item_classes"), F.col("mark_classes")).alias("class_score"))
    scored = scored.withColumn("score", F.round(composite_score(F.col("text_score"), F.col("phonetic_score"), F.col("class_score"), weights), 6)).where(F.col("score") >= threshold)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
