"""Normalising raw records: alias keys of JSON, coerced lists, paired goods and services terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import terms


# The fields of a mark that versions keep.
TRACKED_FIELDS = (
    "source_id",
    "application_number",
    "application_date",
    "registration_number",
    "registration_date",
    "word_mark",
    "figurative_mark_url",
    "status",
    "renewal_status",
    "nice_classes",
    "applicants",
    "representatives",
    "goods_services",
    "jurisdiction",
)


def snapshot(values: dict[str, Column]) -> Column:
    """JSON of a mark's fields in the given order; dates and times in ISO form, nulls kept."""
    options = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}
    return F.to_json(F.struct(*[v.alias(f) for f, v in values.items()]), options)


def named_parties(parties: Column) -> Column:
    """The parties of an array that have a name."""
    return F.filter(parties, lambda p: p.isNotNull() & (F.coalesce(p["name"], F.lit("")) != ""))


def first_of(record: Column, *keys: str, kind: str = "string") -> Column:
    """The first non-null value of a variant's keys."""
    return F.coalesce(*[F.try_variant_get(record, f"$.{k}", kind) for k in keys])


def parsed(raw: Column) -> Column:
    return F.try_parse_json(raw)


def int_list(record: Column, key: str) -> Column:
    """An array of ints from a list or a single value; null if there is neither."""
    return F.coalesce(F.try_variant_get(record, f"$.{key}", "array<int>"), F.array_compact(F.array(F.try_variant_get(record, f"$.{key}", "int"))))


def goods_terms(classes: Column, text: Column) -> Column:
    """(class, term) pairs: by position if the counts agree, else the whole text for every class; classes 1 to 45, no repeats."""
    split = terms(text)
    by_place = F.zip_with(classes, split, lambda c, t: F.struct(c.alias("class_number"), t.alias("term")))
    whole = F.transform(classes, lambda c: F.struct(c.alias("class_number"), F.trim(text).alias("term")))
    pairs = F.when(F.size(classes) == F.size(split), by_place).otherwise(whole)
    return F.array_distinct(F.filter(pairs, lambda p: p["class_number"].between(1, 45)))


def source_id(given: Column, jurisdiction: Column, number: Column) -> Column:
    return F.coalesce(given, F.when(number.isNotNull(), F.concat(F.coalesce(jurisdiction, F.lit("EUIPO")), F.lit("-"), number)))
