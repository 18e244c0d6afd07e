"""Confidence and registrability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.plans.base import SQL_MARK, mark_name, query, sql_fold

_STATES = ", ".join(f"'{s}'" for s in S.STATUSES)
_RECORD = f"""rec AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 9, '0') WHEN 2 THEN 'N-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 3 THEN '???' ELSE 'X' END AS num, {SQL_MARK} AS mark, ['registered', 'application filed', 'SOMETHING_ODD', ''][(p_partkey % 4 + 1)::INT] AS st,
    ['2024-01-15', 'not-a-date', '', '2023-12-31T10:00:00Z'][(p_partkey % 4 + 1)::INT] AS dt, CASE p_partkey % 3 WHEN 0 THEN ['9', '42'] WHEN 1 THEN ['9', '99'] ELSE ['garbage'] END AS cl, ['EUIPO', 'PT', 'US'][(p_partkey % 3 + 1)::INT] AS jur FROM part),
sc AS (SELECT *, CASE WHEN num = '' THEN 0.0 WHEN (jur = 'EUIPO' AND regexp_matches(num, '^\\d{{6,10}}$')) OR (jur = 'PT' AND regexp_matches(num, '(?i)^(?:[A-Z]{{1,3}}[-/ ]?)?\\d{{4,8}}$')) OR (jur = 'US' AND (regexp_matches(num, '^\\d{{6,10}}$') OR regexp_matches(num, '(?i)^(?:[A-Z]{{1,3}}[-/ ]?)?\\d{{4,8}}$'))) THEN 1.0 ELSE 0.5 END::DOUBLE AS s1,
    CASE WHEN trim(mark) = '' THEN 0.0 WHEN length(trim(mark)) < 2 THEN 0.4 WHEN length(regexp_replace(trim(mark), '[^\\pL\\pN\\s]', '', 'g'))::DOUBLE / length(trim(mark)) >= 0.6::DOUBLE THEN 1.0 ELSE 0.5 END::DOUBLE AS s2,
    CASE WHEN st = '' THEN 0.0 WHEN upper(trim(st)) IN ({_STATES}) OR replace(upper(trim(st)), ' ', '_') IN ({_STATES}) THEN 1.0 ELSE 0.7 END::DOUBLE AS s3,
    CASE WHEN dt = '' THEN 0.0 WHEN try_cast(substr(dt, 1, 10) AS DATE) IS NOT NULL THEN 1.0 ELSE 0.3 END::DOUBLE AS s4, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.2 END::DOUBLE AS s5 FROM rec),
ov AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, s1 * 0.3::DOUBLE + s2 * 0.3::DOUBLE + s3 * 0.15::DOUBLE + s4 * 0.1::DOUBLE + s5 * 0.15::DOUBLE)) AS overall FROM sc)"""


@query(
    "confidence_scores",
    f"""WITH {_RECORD} SELECT p_partkey, round(overall, 6) AS overall, array_to_string(list_filter([CASE WHEN s1 < 1 THEN 'application_number' END, CASE WHEN s2 < 1 THEN 'word_mark' END, CASE WHEN s3 < 1 THEN 'status' END, CASE WHEN s4 < 1 THEN 'application_date' END, CASE WHEN s5 < 1 THEN 'nice_classes' END], lambda x: x IS NOT NULL), ',') AS issues, round(overall, 10) < 0.6 AS needs_review FROM ov""",
)
def confidence_scores(read):
    """The confidence of a record, its issues, and whether it needs review."""
    i = F.col("p_partkey")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    number = F.when(i % 5 == 0, "").when(i % 5 == 1, F.lpad(i.cast("string"), 9, "0")).when(i % 5 == 2, F.concat(F.lit("N-"), F.lpad(i.cast("string"), 6, "0"))).when(i % 5 == 3, "???").otherwise("X")
    classes = F.when(i % 3 == 0, F.array(F.lit("9"), F.lit("42"))).when(i % 3 == 1, F.array(F.lit("9"), F.lit("99"))).otherwise(F.array(F.lit("garbage")))
    found = S.record_confidence(number, mark_name(), pick("registered", "application filed", "SOMETHING_ODD", ""), pick("2024-01-15", "not-a-date", "", "2023-12-31T10:00:00Z"), classes, pick("EUIPO", "PT", "US"))
    return read("part").select("p_partkey", found.alias("c")).select("p_partkey", F.round("c.overall", 6).alias("overall"), F.array_join("c.issues", ",").alias("issues"), "c.needs_review")


_ADJ = {0: "loja de software", 1: "cafe e pastelaria", 2: "serviços jurídicos e advocacia", 3: "comércio eletrónico de moda", 4: "nada", 5: "plataforma SaaS de dados"}
_ABOUT_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _ADJ.items()) + " END"
_GENERIC = ", ".join(f"'{t}'" for t in S.GENERIC_TERMS)
_TOK = lambda x: f"regexp_extract_all({sql_fold(x)}, '[a-z0-9]+')"
_ASSESS = f"""req AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' Shop Online' WHEN 1 THEN p_name WHEN 2 THEN 'Moda ' || p_type ELSE CASE WHEN p_size % 5 = 0 THEN '' ELSE 'x' || p_size END END AS mark, {_ABOUT_SQL} AS about, CASE WHEN p_partkey % 3 = 0 THEN [p_size % 50 + 1] ELSE [] END AS given, p_size FROM part),
tk AS (SELECT *, {_TOK('mark')} AS own, {_TOK('about')} AS words FROM req),
ds AS (SELECT *, CASE WHEN len(own) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0::DOUBLE - len(list_filter(own, lambda t: list_contains([{_GENERIC}], t)))::DOUBLE / len(own) * 55.0::DOUBLE - len(list_filter(own, lambda t: list_contains(words, t)))::DOUBLE / len(own) * 20.0::DOUBLE
    - CASE WHEN length(array_to_string(own, '')) <= 2 THEN 40.0 WHEN length(array_to_string(own, '')) <= 3 THEN 15.0 ELSE 0.0 END::DOUBLE) END AS score FROM tk),
lv AS (SELECT *, CASE WHEN score >= 70 THEN 'fully_met' WHEN score >= 40 THEN 'partially_met' ELSE 'not_met' END AS level, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_size * 2)::DOUBLE END AS best, p_size % 11 = 0 AS identical FROM ds),
rk AS (SELECT *, CASE WHEN identical OR coalesce(best, 0) >= 85 OR level = 'not_met' THEN 'high' WHEN coalesce(best, 0) >= 70 OR level = 'partially_met' THEN 'medium' ELSE 'low' END AS risk FROM lv),
vd AS (SELECT *, CASE WHEN identical OR level = 'not_met' OR risk = 'high' THEN 'not_recommended' WHEN risk = 'medium' OR level = 'partially_met' THEN 'eligible_with_risk' ELSE 'eligible' END AS verdict FROM rk)"""


def _requests(read):
    k, size = F.col("p_partkey"), F.col("p_size")
    mark = F.when(k % 4 == 0, F.concat("p_name", F.lit(" Shop Online"))).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.concat(F.lit("Moda "), "p_type")).when(size % 5 == 0, "").otherwise(F.concat(F.lit("x"), size.cast("string")))
    about = F.create_map(*[F.lit(x) for kv in _ADJ.items() for x in kv])[(k % 6).cast("int")]
    given = F.when(k % 3 == 0, F.array((size % 50 + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = read("part").select("p_partkey", "p_size", mark.alias("mark"), about.alias("about"), given.alias("given"))
    rows = rows.withColumn("d", S.distinctiveness(F.col("mark"), F.col("about")))
    best = F.when(size % 4 == 0, None).otherwise((size * 2).cast("double"))
    rows = rows.withColumns({"level": F.col("d.level"), "best": best, "identical": size % 11 == 0})
    rows = rows.withColumn("risk", S.opposition_risk(F.col("level"), F.col("best"), F.col("identical")))
    return rows.withColumn("verdict", S.verdict(F.col("level"), F.col("risk"), F.col("identical")))


@query("distinctiveness", f"WITH {_ASSESS} SELECT p_partkey, mark, round(score, 1) AS score, level FROM ds JOIN lv USING (p_partkey, mark, score)")
def distinctiveness(read):
    """Score and level of a proposed mark."""
    return _requests(read).select("p_partkey", "mark", F.col("d.score").alias("score"), "level")


@query(
    "verdicts",
    f"""WITH {_ASSESS} SELECT p_partkey, level, risk, verdict, CASE verdict WHEN 'not_recommended' THEN 'Registration not recommended' WHEN 'eligible_with_risk' THEN 'Eligible with reservations' ELSE 'Eligible for filing' END AS label,
    CASE WHEN verdict = 'not_recommended' OR risk = 'high' THEN 'Significant issue identified' WHEN verdict = 'eligible_with_risk' OR risk = 'medium' THEN 'Review recommended' ELSE 'No obvious issue identified' END AS public_status FROM vd""",
)
def verdicts(read):
    """Risk, verdict and public status."""
    return _requests(read).select("p_partkey", "level", "risk", "verdict", S.verdict_label(F.col("verdict")).alias("label"), S.public_status(F.col("verdict"), F.col("risk")).alias("public_status"))


_TERMS = ", ".join(f"({c}, {i}, '{t}')" for c, ts in S.CLASS_TERMS.items() for i, t in enumerate(ts))
_TITLES = "map {" + ", ".join(f"{c}: '{t}'" for c, t in S.CLASS_TITLES.items()) + "}"


@query(
    "class_recommendation",
    f"""WITH {_ASSESS}, kw AS (SELECT * FROM (VALUES {_TERMS}) AS t(c, i, term)),
hit AS (SELECT p_partkey, c, arg_min(term, i) AS term FROM tk, kw WHERE CASE WHEN term LIKE '% %' THEN contains({sql_fold('about')}, term) ELSE list_contains(words, term) END GROUP BY p_partkey, c),
sug AS (SELECT h.p_partkey, h.c AS class_number, 'Suggested from the activity description (term “' || term || '”).' || CASE WHEN list_contains(given, c) THEN ' Also indicated by the applicant.' ELSE '' END AS reason FROM hit h JOIN tk USING (p_partkey)),
own AS (SELECT p_partkey, g AS class_number, 'Indicada pelo requerente.' AS reason FROM (SELECT p_partkey, unnest(given) AS g FROM tk) WHERE g BETWEEN 1 AND 45 AND (p_partkey, g) NOT IN (SELECT (p_partkey, class_number) FROM sug)),
every AS (SELECT * FROM sug UNION ALL SELECT * FROM own)
SELECT p_partkey, class_number::INT AS class_number, coalesce({_TITLES}[class_number::INT], 'Class ' || class_number) AS title, reason FROM (SELECT * FROM every UNION ALL SELECT p_partkey, 35, 'Generic business class recommended by default in the absence of a specific description.' FROM tk WHERE p_partkey NOT IN (SELECT p_partkey FROM every))""",
)
def class_recommendation(read):
    """M9: classes suggested by a description, with the applicant's own and the default."""
    return _requests(read).select("p_partkey", F.inline(S.recommended_classes(F.col("about"), F.col("given"))))


@query(
    "report_recommendations",
    f"""WITH {_ASSESS} SELECT p_partkey, 1 + (level <> 'fully_met')::INT + 1 + (p_size % 4 = 0)::INT AS n_advice, CASE WHEN identical THEN 'An identical mark was found; a detailed legal analysis is recommended before proceeding with the application.' WHEN risk IN ('medium', 'high') THEN 'Similar earlier marks exist; assess the overlap of classes and market context to estimate confusion risk.' ELSE 'On average, only around 5% of applications face opposition; filing may be appropriate, especially if you already trade under this mark.' END AS advice,
    CASE WHEN p_size % 4 <> 0 THEN 'The preliminary check found potentially relevant earlier marks. A professional review is recommended before relying on the result.' ELSE 'The preliminary check ran, but earlier-right data was unavailable. Repeat the check or request expert review before filing.' END AS explanation FROM vd""",
)
def report_recommendations(read):
    """The advice and the public explanation of a report."""
    rows = _requests(read)
    provenance = F.when(F.col("best").isNull(), "unavailable").otherwise("database")
    advice = S.recommendations(S.recommended_classes(F.col("about"), F.col("given")), F.col("level"), F.col("identical"), F.col("risk"), provenance)
    place = F.when(F.col("level") != "fully_met", 3).otherwise(2)
    return rows.select("p_partkey", F.size(advice).alias("n_advice"), F.element_at(advice, place).alias("advice"), S.public_explanation(F.col("best").isNotNull().cast("int"), provenance).alias("explanation"))
