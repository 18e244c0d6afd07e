"""Confidence of extracted records and registrability assessment, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.dates import iso_date
from tidemark.functions.text import bind, fold, tokens

REVIEW_THRESHOLD = 0.6

# Known states of a record, event types of a bulletin, and field weights.
STATUSES = (
    "REGISTERED", "PUBLISHED", "APPLICATION_PUBLISHED", "FILED", "APPLICATION FILED", "UNDER_EXAMINATION", "OPPOSED",
    "OPPOSITION_PENDING", "REFUSED", "WITHDRAWN", "EXPIRED", "CANCELLED", "SURRENDERED",
)
EVENT_TYPES = ("publication", "grant", "provisional_refusal", "opposition_filed", "renewal", "lapse", "transfer", "change_name")
WEIGHTS = {"application_number": 0.30, "word_mark": 0.30, "status": 0.15, "application_date": 0.10, "nice_classes": 0.15}
EU_NUMBER = r"^\d{6,10}$"
PT_NUMBER = r"(?i)^(?:[A-Z]{1,3}[-/ ]?)?\d{4,8}$"


def _filled(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def number_score(number: Column, jurisdiction: Column) -> Column:
    v, j = F.trim(number), F.upper(F.coalesce(jurisdiction, F.lit("")))
    eu, pt = v.rlike(EU_NUMBER), v.rlike(PT_NUMBER)
    fits = F.when(j.isin("EUIPO", "EU"), eu).when(j.isin("INPI", "PT"), pt).otherwise(eu | pt)
    return F.when(~_filled(number), 0.0).when(fits, 1.0).otherwise(0.5)


def word_mark_score(mark: Column) -> Column:
    t = F.trim(mark)
    share = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", "")) / F.length(t)
    return F.when(~_filled(t), 0.0).when(F.length(t) < 2, 0.4).when(share >= 0.6, 1.0).otherwise(0.5)


def status_score(status: Column) -> Column:
    up = F.upper(F.trim(status))
    return F.when(~_filled(status), 0.0).when(up.isin(*STATUSES) | F.replace(up, F.lit(" "), F.lit("_")).isin(*STATUSES), 1.0).otherwise(0.7)


def date_score(text: Column) -> Column:
    return F.when(~_filled(text), 0.0).when(iso_date(text).isNotNull(), 1.0).otherwise(0.3)


def classes_score(classes: Column) -> Column:
    """Share of classes from 1 to 45 in an array of strings; 0.2 if one is no number."""
    numbers = F.transform(classes, lambda c: c.try_cast("int"))
    good = F.size(F.filter(numbers, lambda c: c.between(1, 45)))
    return F.when(F.coalesce(F.size(classes), F.lit(0)) <= 0, 0.0).when(F.exists(numbers, lambda c: c.isNull()), 0.2).otherwise(good / F.size(classes))


def record_confidence(number: Column, mark: Column, status: Column, date: Column, classes: Column, jurisdiction: Column) -> Column:
    """Struct: overall, issues (fields below 1), needs_review."""
    scores = {"application_number": number_score(number, jurisdiction), "word_mark": word_mark_score(mark), "status": status_score(status), "application_date": date_score(date), "nice_classes": classes_score(classes)}
    total = sum((scores[k] * F.lit(w) for k, w in WEIGHTS.items()), F.lit(0.0))
    overall = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    issues = F.array_compact(F.array(*[F.when(s < 1.0, F.lit(k)) for k, s in scores.items()]))
    return F.struct(overall.alias("overall"), issues.alias("issues"), (F.round(overall, 10) < REVIEW_THRESHOLD).alias("needs_review"))


def event_confidence(event_type: Column, number: Column, excerpt: Column, has_date: Column) -> Column:
    n = F.length(F.trim(F.coalesce(excerpt, F.lit(""))))
    by_length = F.when(n >= 40, 1.0).when(n >= 10, 0.6).otherwise(0.2)
    return F.when(event_type.isin(*EVENT_TYPES), 1.0).otherwise(0.3) * 0.25 + number_score(number, F.lit("PT")) * 0.40 + by_length * 0.20 + F.when(has_date, 1.0).otherwise(0.0) * 0.15


# Terms with little distinctive character.
GENERIC_TERMS = (
    "loja shop store online web tech digital group grupo company empresa servico servicos services solucoes solutions consultoria "
    "consulting market marketing cloud data software app studio design media global express pro plus premium center centro clinica "
    "cafe restaurante bar hotel seguros banco finance financas the and de da do e"
).split()
# Titles of goods and services classes.
CLASS_TITLES = {
    3: "Cosmetics and hygiene products",
    5: "Pharmaceutical products",
    9: "Software, devices and IT equipment",
    25: "Clothing, footwear and headgear",
    29: "Food of animal origin and preserves",
    30: "Coffee, tea, bakery and food products",
    35: "Advertising, business management and e-commerce",
    36: "Financial and insurance services",
    41: "Education, training and entertainment",
    42: "Scientific and technological services; R&D; SaaS",
    43: "Restaurant and accommodation services",
    44: "Medical, health and beauty services",
    45: "Legal and security services",
}
# The terms of a business description that suggest a class, in order of preference.
CLASS_TERMS = {
    3: ("cosmetico", "cosmeticos", "perfume", "perfumaria", "higiene", "sabonete"),
    5: ("farmaceutico", "farmacia", "medicamento", "suplemento", "vitaminas"),
    9: ("software", "aplicacao", "aplicacoes", "app", "informatica", "hardware", "mobile", "jogo", "jogos", "tecnologia", "eletronica"),
    25: ("roupa", "vestuario", "moda", "calcado", "sapatos", "chapelaria", "textil"),
    29: ("conservas", "carne", "peixe", "laticinios", "enchidos"),
    30: ("cafe", "cha", "padaria", "pastelaria", "chocolate", "bolos", "pao"),
    35: ("loja", "lojas", "ecommerce", "comercio", "comercio eletronico", "venda", "vendas", "retalho", "publicidade", "marketing", "negocio", "negocios", "consultoria", "gestao", "marketplace"),
    36: ("seguros", "financas", "financeiro", "banco", "banca", "investimento", "fintech", "pagamentos", "credito"),
    41: ("educacao", "formacao", "cursos", "ensino", "entretenimento", "eventos", "escola"),
    42: ("saas", "software", "desenvolvimento", "tecnologia", "cloud", "nuvem", "dados", "plataforma", "engenharia", "investigacao", "design", "web"),
    43: ("restaurante", "restauracao", "cafe", "bar", "hotel", "alojamento", "catering", "comida"),
    44: ("clinica", "saude", "medico", "estetica", "beleza", "spa", "dentista"),
    45: ("juridico", "juridicos", "advocacia", "advogado", "legal", "seguranca", "direito"),
}
DEFAULT_CLASS = 35


def distinctiveness(mark: Column, description: Column) -> Column:
    """Struct: score (one decimal) and level of a proposed mark."""
    own, about = tokens(mark), tokens(description)
    n = F.size(own)
    generic = F.size(F.filter(own, lambda t: t.isin(*GENERIC_TERMS))) / n
    descriptive = F.size(F.filter(own, lambda t: F.array_contains(about, t))) / n
    compact = F.length(F.array_join(own, ""))
    short = F.when(compact <= 2, 40.0).when(compact <= 3, 15.0).otherwise(0.0)
    raw = F.when(n > 0, F.greatest(F.lit(0.0), F.lit(100.0) - generic * 55.0 - descriptive * 20.0 - short)).otherwise(0.0)
    return F.struct(F.round(raw, 1).alias("score"), F.when(raw >= 70, "fully_met").when(raw >= 40, "partially_met").otherwise("not_met").alias("level"))


# The sentences of a report.
TEXTS = {
    "default_class": "Generic business class recommended by default in the absence of a specific description.",
    "given_class": "Indicada pelo requerente.",
    "strengthen": "Strengthen the mark’s distinctive component (for example, an invented word element or figurative element) to reduce the risk of refusal.",
    "identical": "An identical mark was found; a detailed legal analysis is recommended before proceeding with the application.",
    "similar": "Similar earlier marks exist; assess the overlap of classes and market context to estimate confusion risk.",
    "clear": "On average, only around 5% of applications face opposition; filing may be appropriate, especially if you already trade under this mark.",
    "repeat": "The earlier-right search could not be completed at this time; repeat the check for a complete analysis before deciding.",
    "status_high": "Significant issue identified",
    "status_medium": "Review recommended",
    "status_low": "No obvious issue identified",
    "found": "The preliminary check found potentially relevant earlier marks. A professional review is recommended before relying on the result.",
    "unavailable": "The preliminary check ran, but earlier-right data was unavailable. Repeat the check or request expert review before filing.",
    "nothing": "No obvious issue was identified in this preliminary automated check. This is not a legal clearance opinion.",
}
VERDICT_LABELS = {"not_recommended": "Registration not recommended", "eligible_with_risk": "Eligible with reservations", "eligible": "Eligible for filing"}


def recommended_classes(description: Column, provided: Column) -> Column:
    """Array of (class_number, title, reason), ascending; class 35 if nothing speaks for another."""
    given = F.coalesce(provided, F.array().cast("array<int>"))
    about = F.struct(fold(F.coalesce(description, F.lit(""))).alias("text"), tokens(description).alias("words"))
    return bind(F.struct(about.alias("about"), given.alias("given")), lambda x: bind(_suggested(x["about"], x["given"]), lambda s: _with_given(s, x["given"])))


def _suggested(about: Column, given: Column) -> Column:
    found = []
    for number, listed in CLASS_TERMS.items():
        first = F.coalesce(*[F.when(F.contains(about["text"], F.lit(t)) if " " in t else F.array_contains(about["words"], t), F.lit(t)) for t in listed])
        reason = F.concat(F.lit("Suggested from the activity description (term “"), first, F.lit("”)."), F.when(F.array_contains(given, number), " Also indicated by the applicant.").otherwise(""))
        found.append(F.struct(F.lit(number).alias("class_number"), F.lit(CLASS_TITLES[number]).alias("title"), reason.alias("reason")))
    return F.filter(F.array(*found), lambda x: x["reason"].isNotNull())


def _with_given(suggested: Column, given: Column) -> Column:
    titles = F.create_map(*[F.lit(v) for k, t in CLASS_TITLES.items() for v in (k, t)])
    rest = F.array_except(F.filter(F.array_distinct(given), lambda c: c.between(1, 45)), F.transform(suggested, lambda x: x["class_number"]))
    added = F.transform(rest, lambda c: F.struct(c.alias("class_number"), F.coalesce(F.try_element_at(titles, c), F.concat(F.lit("Class "), c.cast("string"))).alias("title"), F.lit(TEXTS["given_class"]).alias("reason")))
    every = F.array_sort(F.concat(suggested, added))
    default = F.array(F.struct(F.lit(DEFAULT_CLASS).alias("class_number"), F.lit(CLASS_TITLES[DEFAULT_CLASS]).alias("title"), F.lit(TEXTS["default_class"]).alias("reason")))
    return F.when(F.size(every) > 0, every).otherwise(default)


def opposition_risk(level: Column, best: Column, identical: Column) -> Column:
    """low, medium or high from the distinctiveness, the best candidate's similarity (null: none) and identity."""
    top = F.coalesce(best, F.lit(0.0))
    return F.when(identical | (top >= 85) | (level == "not_met"), "high").when((top >= 70) | (level == "partially_met"), "medium").otherwise("low")


def verdict(level: Column, risk: Column, identical: Column) -> Column:
    return F.when(identical | (level == "not_met") | (risk == "high"), "not_recommended").when((risk == "medium") | (level == "partially_met"), "eligible_with_risk").otherwise("eligible")


def verdict_label(v: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in VERDICT_LABELS.items() for x in pair])[v]


def recommendations(classes: Column, level: Column, identical: Column, risk: Column, provenance: Column) -> Column:
    """The ordered advice texts of a report."""
    listed = F.array_join(F.transform(classes, lambda c: c["class_number"].cast("string")), ", ")
    return F.array_compact(F.array(
        F.when(listed != "", F.concat(F.lit("Consider filing the trademark in Nice classes "), listed, F.lit(", de acordo com a atividade descrita."))),
        F.when(level != "fully_met", TEXTS["strengthen"]),
        F.when(identical, TEXTS["identical"])
        .when(risk.isin("medium", "high"), TEXTS["similar"])
        .otherwise(TEXTS["clear"]),
        F.when(provenance == "unavailable", TEXTS["repeat"]),
    ))


def public_status(v: Column, risk: Column) -> Column:
    return F.when((v == "not_recommended") | (risk == "high"), TEXTS["status_high"]).when((v == "eligible_with_risk") | (risk == "medium"), TEXTS["status_medium"]).otherwise(TEXTS["status_low"])


def public_explanation(n_candidates: Column, provenance: Column) -> Column:
    return (
        F.when(n_candidates > 0, TEXTS["found"])
        .when(provenance == "unavailable", TEXTS["unavailable"])
        .otherwise(TEXTS["nothing"])
    )
