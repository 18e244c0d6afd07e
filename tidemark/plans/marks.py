"""Search and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.metaphone import metaphone_code
from tidemark.functions.similarity import class_overlap, code_similarity, pt_phonetic_similarity, similarity_band
from tidemark.functions.text import pt_phonetic_code, slug, trigrams
from tidemark.operators.matching import similar_marks, trigram_pairs
from tidemark.plans.base import SQL_MARK, mark_name, query, sql_jaccard, sql_lcs, sql_pt_code, sql_trigrams


@query(
    "mark_search",
    """SELECT p_partkey, p_name, p_size, p_brand FROM part WHERE p_name ILIKE '%bl%' AND p_size % 5 = 0 AND list_contains([p_size % 45 + 1, (p_size * 7) % 45 + 1], 11) ORDER BY p_name, p_partkey LIMIT 200 OFFSET 0""",
)
def mark_search(read):
    """Containment, optional filters, class containment, ordered page."""
    part = read("part")
    classes = F.array(F.col("p_size") % 45 + 1, (F.col("p_size") * 7) % 45 + 1)
    found = part.where(F.col("p_name").ilike("%bl%") & (F.col("p_size") % 5 == 0) & F.array_contains(classes, 11))
    return found.orderBy("p_name", "p_partkey").offset(0).limit(200).select("p_partkey", "p_name", "p_size", "p_brand")


def _marks(read):
    return read("part").select(F.col("p_partkey").alias("id"), mark_name().alias("text"), F.array((F.col("p_partkey") % 7 + 1).cast("int"), (F.col("p_size") % 45 + 1).cast("int")).alias("classes"))


_SQL_MARKS = f"""marks AS (SELECT p_partkey AS id, {SQL_MARK} AS text, [p_partkey % 7 + 1, p_size % 45 + 1] AS classes FROM part),
texts AS (SELECT DISTINCT text AS t, {sql_trigrams('text')} AS g FROM marks),
pairs AS (SELECT x.t AS a, y.t AS b, {sql_jaccard('x.g', 'y.g')} AS trgm FROM (SELECT * FROM texts WHERE t IN (SELECT text FROM marks WHERE id % 20 = 0)) x, texts y WHERE {sql_jaccard('x.g', 'y.g')} > 0.2)"""

_SQL_SIMILAR = f"""WITH {_SQL_MARKS},
cands AS (SELECT i.id AS item_id, m.id AS mark_id, p.a, p.b, trgm, i.classes AS ic, m.classes AS mc, row_number() OVER (PARTITION BY i.id ORDER BY trgm DESC, m.id) AS pos
    FROM pairs p JOIN marks i ON i.text = p.a AND i.id % 20 = 0 JOIN marks m ON m.text = p.b WHERE i.id <> m.id),
top AS (SELECT * FROM cands WHERE pos <= 15),
scored AS (SELECT *, CASE WHEN length(a) > 0 AND length(b) > 0 THEN 200.0::DOUBLE * {sql_lcs('lower(a)', 'lower(b)').replace('j[1]', 'j')} / (length(a) + length(b)) ELSE 0 END AS text_score,
    CASE WHEN {sql_pt_code('a')} = {sql_pt_code('b')} AND {sql_pt_code('a')} <> '' THEN 100.0 ELSE 0.0 END::DOUBLE AS phonetic_score,
    100 * {sql_jaccard('list_distinct(ic)', 'list_distinct(mc)')} AS class_score FROM top),
final AS (SELECT *, round(text_score * 0.5::DOUBLE + phonetic_score * 0.3::DOUBLE + class_score * 0.2::DOUBLE, 6) AS score FROM scored)
SELECT item_id, mark_id, a AS item_text, b AS mark_text, round(trgm, 6) AS trgm, score, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS band,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos)::INT AS rank FROM final WHERE score >= 40 QUALIFY rank <= 5"""
_SQL_SIMILAR = _SQL_SIMILAR.replace("range(1, length(lower(b)) + 1)::BIGINT[], lambda done, j:", "list_transform(range(1, length(lower(b)) + 1), lambda q: [q]), lambda done, jj:").replace("substr(lower(b), j, 1)", "substr(lower(b), jj[1], 1)").replace("prev[j]", "prev[jj[1]]").replace("prev[j + 1]", "prev[jj[1] + 1]")


def _shown(found):
    return found.select("item_id", "mark_id", F.col("a").alias("item_text"), F.col("b").alias("mark_text"), F.round("trgm", 6).alias("trgm"), "score", similarity_band(F.col("score")).alias("band"), "rank")


@query("similar_marks", _SQL_SIMILAR)
def similar(read):
    """Every twentieth mark is watched against all marks."""
    marks = _marks(read)
    return _shown(similar_marks(marks.where("id % 20 = 0"), marks))


# Metaphone codes of the words of the marks.
_CODES = {
    "ECONOMY": "EKNM", "LARGE": "LRJ", "MEDIUM": "MTM", "PROMO": "PRM", "SMALL": "SML", "STANDARD": "STNTRT", "anvil": "ANFL", "blue": "BL", "bolt": "BLT", "cold": "KLT", "gear": "JR",
    "gizmo": "JSM", "hot": "HT", "large": "LRJ", "new": "N", "old": "OLT", "plate": "PLT", "red": "RT", "ring": "RNK", "rod": "RT", "small": "SML", "widget": "WJT",
}


def _sql_metaphone(x: str) -> str:
    """The code of a text of known words, word by word."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: map {{{', '.join(f"'{w}': '{c}'" for w, c in _CODES.items())}}}[w]), ' ')"


_PT_SCORE = f"CASE WHEN {sql_pt_code('a')} = {sql_pt_code('b')} AND {sql_pt_code('a')} <> '' THEN 100.0 ELSE 0.0 END::DOUBLE AS phonetic_score"


@query("similar_marks_metaphone", _SQL_SIMILAR.replace(_PT_SCORE, _PT_SCORE.replace("THEN 100.0", f"OR {_sql_metaphone('a')} = {_sql_metaphone('b')} THEN 100.0")))
def similar_metaphone(read):
    """The same with the Metaphone code as a second phonetic score."""
    marks = _marks(read)
    return _shown(similar_marks(marks.where("id % 20 = 0"), marks, extra_phonetic=lambda a, b: code_similarity(metaphone_code(a), metaphone_code(b))))


@query("trigram_operator", f"""WITH {_SQL_MARKS.replace('> 0.2)', '>= 0.3)')} SELECT a, b, round(trgm, 6) AS trgm FROM pairs""")
def trigram_operator(read):
    """The % operator's threshold of 0.3, for watched texts against all texts."""
    marks = _marks(read)
    texts = marks.select(F.col("text").alias("t"))
    return trigram_pairs(marks.where("id % 20 = 0").select(F.col("text").alias("t")), texts, 0.3, strict=False).select("a", "b", F.round("trgm", 6).alias("trgm"))


@query("trigram_counts", f"SELECT g, count(*) AS n FROM (SELECT unnest({sql_trigrams('p_name')}) AS g FROM part) GROUP BY g")
def trigram_counts(read):
    """R2: the postings of the trigram index, by trigram."""
    return read("part").select(F.explode(trigrams(F.col("p_name"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("pt_phonetic_groups", f"SELECT {sql_pt_code(SQL_MARK)} AS code, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1")
def phonetic_groups(read):
    """Marks by Portuguese phonetic code."""
    return read("part").select("p_partkey", pt_phonetic_code(mark_name()).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"))


@query("metaphone_groups", f"SELECT {_sql_metaphone(SQL_MARK)} AS code, count(*) AS n FROM part GROUP BY 1")
def metaphone_groups(read):
    """Marks by Metaphone code."""
    names = read("part").select(mark_name().alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    return names.select(metaphone_code("name").alias("code"), "rows").groupBy("code").agg(F.sum("rows").alias("n"))


@query("metaphone_known", f"SELECT w AS name, {_sql_metaphone('w')} AS code, count(*) AS n FROM (SELECT unnest(string_split({SQL_MARK}, ' ')) AS w FROM part) GROUP BY w")
def metaphone_known(read):
    """The codes of the words of all marks."""
    words = read("part").select(F.explode(F.split(mark_name(), " ")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return words.select("name", metaphone_code("name").alias("code"), "n")


@query(
    "phonetic_known",
    f"""WITH p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS a, p_type AS b FROM part)
SELECT a, b, CASE WHEN {_sql_metaphone('a')} = {_sql_metaphone('b')} OR {sql_pt_code('a')} = {sql_pt_code('b')} THEN 100.0 ELSE 0.0 END::DOUBLE AS score FROM p""",
)
def phonetic_known(read):
    """The better of the Metaphone and the Portuguese score of each word of a mark's name with its type."""
    pairs = read("part").select(F.explode(F.split("p_name", " ")).alias("a"), F.col("p_type").alias("b")).distinct()
    return pairs.select("a", "b", F.greatest(code_similarity(metaphone_code("a"), metaphone_code("b")), pt_phonetic_similarity(F.col("a"), F.col("b"))).alias("score"))


@query(
    "class_jaccard",
    f"""SELECT o_orderkey, round(100 * {sql_jaccard('a', 'b')}, 6) AS overlap FROM (SELECT o_orderkey, list_distinct([o_custkey % 5 + 1, o_orderkey % 5 + 1]) AS a, list_distinct([o_orderkey % 3 + 1, 2, o_custkey % 4 + 1]) AS b FROM orders)""",
)
def class_jaccard(read):
    """Overlap of two class lists."""
    a = F.array((F.col("o_custkey") % 5 + 1).cast("int"), (F.col("o_orderkey") % 5 + 1).cast("int"))
    b = F.array((F.col("o_orderkey") % 3 + 1).cast("int"), F.lit(2), (F.col("o_custkey") % 4 + 1).cast("int"))
    return read("orders").select("o_orderkey", F.round(class_overlap(a, b), 6).alias("overlap"))


@query(
    "class_overlap_filter",
    "SELECT p_partkey, p_name FROM part WHERE list_has_any([p_size % 45 + 1, (p_size * 7) % 45 + 1], [9, 35, 42]) AND p_name IS NOT NULL",
)
def class_overlap_filter(read):
    """Classes that overlap a list."""
    classes = F.array(F.col("p_size") % 45 + 1, (F.col("p_size") * 7) % 45 + 1)
    return read("part").where(F.arrays_overlap(classes, F.array(*[F.lit(c) for c in (9, 35, 42)]).cast("array<int>")) & F.col("p_name").isNotNull()).select("p_partkey", "p_name")


@query("slugs", "SELECT DISTINCT p_name, trim(regexp_replace(lower(trim(p_name || ' & Co.')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(read):
    """C10."""
    return read("part").select("p_name", slug(F.concat("p_name", F.lit(" & Co."))).alias("slug")).distinct()
