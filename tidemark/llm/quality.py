"""Quality rules whose cutoffs come from quantile sketches per language and source.

Each text gets counts (words, symbols, duplicate lines, repeated 8-word windows) and from them integer
shares. A sketch of a share is its histogram on a fixed integer grid of ``GRID`` steps: counts of equal
bins add up, so sketches of partitions, sources or languages merge without error and a rank is off by no
more than one grid step. Sketched are the documents that pass the base rules.

A share is smoothed by one event, (count + event) / (size + event): a text of few words without a symbol
is known less well to be free of them than a long one, so the shares of a group spread even where most of
its texts have none. A document fails a rule if it has such events and its share lies beyond the fence
``q75 + FENCE * (q75 - q25)`` of its (language, source) sketch; for word length, which isn't smoothed, also below the mirrored fence.
Every fence comes from a sketch. A group under ``LEAST_GROUP`` documents uses the merged sketch of its
language, and a language under it the merged sketch of all.

Windows of one text are compared by 64-bit hashes, which is exact but for collisions within that text.

Nulls: null and empty texts have no words and fail the base rule; a null language or source is a
group of its own. Repeated rows count as often as they occur. Very long texts are processed whole, in
arrays of one row; no row is exploded. An empty table gives no rows. Extra columns, whatever their
names, are kept by ``quality_filter`` and left out by ``quality_verdicts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, bind, free_names, own_columns, read_table, stage_table

LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
LEAST_GROUP = 50
FENCE = 3
#: Steps of a sketch's grid; a share beyond it counts in the last step (one half; word length: 50 characters and more).
GRID = 5_000
#: Rule name: (counted, out of, share of one, side, one event). Shares are in 1/10,000, word length is in 1/100
#: characters; a repeated window adds two windows of words.
RULES = {
    "symbol_share": ("n_symbols", "word_chars", 10_000, "above", 1),
    "upper_share": ("n_upper", "word_chars", 10_000, "above", 1),
    "mark_share": ("n_marks", "word_chars", 10_000, "above", 1),
    "line_share": ("n_dup_lines", "n_lines", 10_000, "above", 1),
    "repeat_share": ("n_repeat_words", "n_words", 10_000, "above", 2 * WINDOW),
    "word_length": ("word_chars", "n_words", 100, "both", 0),
}


def words_of(text: Column) -> Column:
    """The words in order; none for null or blank text."""
    inner = F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")
    none = F.array().cast("array<string>")
    return bind(inner, lambda t: F.when(F.length(t) > 0, F.split(t, SPACE)).otherwise(none))


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Number of words in windows of ``width`` words that occur twice or more in the row.

    Windows are compared as 64-bit hashes of word hashes, within one text only. Most texts repeat no
    window and stop after the distinct count; the others sort (hash, position) and add up the union of
    the repeated windows.
    """

    def windows(hashes: Column) -> Column:
        starts = F.slice(hashes, 1, F.size(hashes) - (width - 1))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, width)]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def union(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(placed, lambda s: bind(
            F.sort_array(F.transform(F.filter(s, lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))), lambda x: x["i"])),
            covered,
        ))

    counted = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(union(w))
    hashed = lambda h: F.when(F.size(h) > width, bind(windows(h), counted)).otherwise(F.lit(0))
    return bind(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def _kept_length(text: Column, dropped: str) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, dropped, "")), F.lit(0))


def text_metrics(text: Column) -> Column:
    """One struct of counts for a text, each evaluated once."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_words = bind(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_window_words(w).alias("n_repeat_words")))
    per_lines = bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    parts = F.struct(
        per_words.alias("w"),
        per_lines.alias("l"),
        _kept_length(text, SPACE).alias("word_chars"),
        _kept_length(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        _kept_length(text, r"[^A-ZÀ-ÖØ-Þ]+").alias("n_upper"),
        _kept_length(text, r"[^!?]+").alias("n_marks"),
    )
    long = lambda c, name: c.cast("long").alias(name)
    return bind(parts, lambda p: F.struct(
        long(p["w"]["n_words"], "n_words"), long(p["word_chars"], "word_chars"), long(p["n_symbols"], "n_symbols"), long(p["l"]["n_dup_lines"], "n_dup_lines"),
        long(p["w"]["n_repeat_words"], "n_repeat_words"), long(p["l"]["n_lines"], "n_lines"), long(p["n_upper"], "n_upper"), long(p["n_marks"], "n_marks"),
    ))


def share_columns(m: str = "") -> dict[str, Column]:
    """The smoothed integer shares of the rules from the metric columns (prefixed ``m``)."""
    return {r: F.coalesce(F.expr(f"({unit} * ({m}{part} + {event})) div nullif({m}{whole} + {event}, 0)"), F.lit(0)) for r, (part, whole, unit, _, event) in RULES.items()}


def sketches(shares: DataFrame) -> DataFrame:
    """Histogram rows (lang, source, rule, bin, n) of every rule's share; counts of equal bins merge."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.col(r), F.lit(GRID)).alias("bin")) for r in RULES])
    return shares.select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "rule", "bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(bins: DataFrame) -> DataFrame:
    """q25 and q75 per (lang, source, rule), from the finest sketch with enough documents."""

    def ranks(level: DataFrame, keys: list[str], name: str) -> DataFrame:
        part = Window.partitionBy(*keys, "rule")
        upto = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = level.withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(part))
        at = lambda q: F.min(F.when(F.col("cum") * 4 >= F.col("total") * q, F.col("bin")))
        return cum.groupBy(*keys, "rule").agg(at(1).alias(f"{name}_25"), at(3).alias(f"{name}_75"), F.max("total").alias(f"{name}_n"))

    fine = ranks(bins, ["lang", "source"], "fine")
    lang = ranks(bins.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n")), ["lang"], "lang").withColumnsRenamed({"lang": "_lang", "rule": "_rule"})
    whole = ranks(bins.groupBy("rule", "bin").agg(F.sum("n").alias("n")), [], "all").withColumnRenamed("rule", "_all_rule")
    pick = lambda q: F.when(F.col("fine_n") >= LEAST_GROUP, F.col(f"fine_{q}")).when(F.col("lang_n") >= LEAST_GROUP, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))
    return (
        fine.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule")))
        .join(whole, F.col("rule") == F.col("_all_rule"))
        .select("lang", "source", "rule", pick(25).alias("q25"), pick(75).alias("q75"))
    )


def quartile_table(facts: DataFrame) -> DataFrame:
    """Staged: lang, source and a struct (rule -> q25, q75); as many rows as pairs with a document that passes the base rules."""
    picks = [F.max(F.when(F.col("rule") == r, F.struct("q25", "q75"))).alias(r) for r in RULES]
    passed = facts.where(~base_failed()).withColumns(share_columns())
    wide = quartiles(sketches(passed)).groupBy("lang", "source").agg(*picks)
    return stage_table(wide.select("lang", "source", F.struct(*RULES).alias("quartiles")), "quality-quartiles")


def base_failed(m: str = "") -> Column:
    return (F.col(f"{m}n_words") < LEAST_WORDS) | (F.lit(100) * F.col(f"{m}n_repeat_words") > F.lit(MOST_REPEATED) * F.col(f"{m}n_words"))


def within_fences(quartiles: Column, m: str = "") -> Column:
    """Whether all shares lie within the fences of the document's group (null without quartiles)."""
    share = share_columns(m)
    found = F.lit(True)
    for r, (part, _, _, side, _) in RULES.items():
        q25, q75 = quartiles[r]["q25"], quartiles[r]["q75"]
        room = (q75 - q25) * FENCE
        low = share[r] >= q25 - room if side == "both" else F.lit(True)
        found = found & ((F.col(f"{m}{part}") == 0) | (low & (share[r] <= q75 + room)))
    return found


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept. The text is scanned once."""
    m = docs.select("doc_id", "lang", "source", text_metrics(F.col("text")).alias("m")).select("doc_id", "lang", "source", "m.*")
    facts = stage_table(m, "quality-facts")
    limits = quartile_table(facts).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = facts.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    kept = F.coalesce(~base_failed() & within_fences(F.col("quartiles")), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``.

    The texts are staged with their counts, so they are measured once and not shuffled to their verdicts.
    """
    m, lang, source, fence = free_names(docs, "counts", "group_lang", "group_source", "group_quartiles")
    measured = stage_table(docs.withColumn(m, text_metrics(F.col("text"))), "quality-measured")
    limits = quartile_table(measured.select("lang", "source", f"{m}.*")).toDF(lang, source, fence)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left")
    return joined.where(~base_failed(f"{m}.") & within_fences(F.col(fence), f"{m}.")).select(*own_columns(docs))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(read_table(spark, folder, "documents"))


def verdict_sql(table: str) -> str:
    """DuckDB SQL with the rows of quality_verdicts over ``table``."""
    shares = ", ".join(f"coalesce({unit} * ({part} + {event}) // nullif({whole} + {event}, 0), 0) AS {r}" for r, (part, whole, unit, _, event) in RULES.items())
    long = "\nUNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, least({r}, {GRID}) AS v FROM shared WHERE NOT base_failed" for r in RULES)
    ok = []
    for r, (part, _, _, side, _) in RULES.items():
        room = f"{FENCE} * (q[2] - q[1])"
        low = f" AND {r} >= q[1] - {room}" if side == "both" else ""
        ok.append(f"({part} = 0 OR (SELECT {r} <= q[2] + {room}{low} FROM picked p WHERE p.rule = '{r}' AND p.lang IS NOT DISTINCT FROM s.lang AND p.source IS NOT DISTINCT FROM s.source))")
    return rf"""
WITH parts AS (SELECT doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(coalesce(text, ''), '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper,
    length(regexp_replace(coalesce(text, ''), '[^!?]+', '', 'g')) AS n_marks,
    row_number() OVER () AS k FROM {table}),
wins AS (SELECT k, i, list_slice(w, i, i + 7) AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM parts)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM wins) WHERE c > 1),
spans AS (SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS n FROM twice),
covered AS (SELECT k, sum(n)::BIGINT AS n FROM spans GROUP BY k),
metrics AS (SELECT p.doc_id, p.lang, p.source, len(w) AS n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, n_upper, n_marks FROM parts p LEFT JOIN covered c USING (k)),
shared AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed, {shares} FROM metrics),
long AS ({long}),
fine AS (SELECT lang, source, rule, quantile_disc(v, [0.25, 0.75]) AS q, count(*) AS n FROM long GROUP BY ALL),
langs AS (SELECT lang, rule, quantile_disc(v, [0.25, 0.75]) AS q, count(*) AS n FROM long GROUP BY ALL),
whole AS (SELECT rule, quantile_disc(v, [0.25, 0.75]) AS q FROM long GROUP BY ALL),
picked AS (SELECT f.lang, f.source, f.rule, CASE WHEN f.n >= {LEAST_GROUP} THEN f.q WHEN l.n >= {LEAST_GROUP} THEN l.q ELSE a.q END AS q
    FROM fine f JOIN langs l ON f.lang IS NOT DISTINCT FROM l.lang AND f.rule = l.rule JOIN whole a ON f.rule = a.rule)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, coalesce(NOT base_failed AND {" AND ".join(ok)}, false) AS kept
FROM shared s"""


QUERIES = {"op4_quality": op4_quality}
ORACLES = {"op4_quality": verdict_sql("documents")}
