"""Events of official bulletins: pages to lines, headings by pattern, a look-ahead for the process number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import REVIEW_THRESHOLD, event_confidence
from tidemark.functions.text import bind, lines

LOOK_AHEAD = 8
LEAST_TEXT = 50
# The number pattern, its whitespace-tolerant form, and the heading patterns by event type.
NUMBER = r"(?iu)(?:N[º°]\s*de\s*pedido|N[º°]\.?\s*Pedido|Application\s*No|Processo)[\s:]*(\S+)"
SPACED_NUMBER = r"(?iu)(?:N[º°]\s*de\s*pedido|N[º°]\.?\s*Pedido|Application\s*No|Processo)[\s:]*(\d{1,3}(?:\s\d{3})+|\S+)"
HEADINGS = {
    "publication": "Publicação|Despacho\\s*de\\s*Publicação|Publicação\\s*do\\s*pedido|Despacho\\s*n\\.?\\s*\\d+",
    "grant": "Concessão|Registo\\s*concedido|Concessão\\s*do\\s*registo",
    "provisional_refusal": "Recusa\\s*Provisória|Recusa|Recusa\\s*absoluta|Recusa\\s*relativa",
    "opposition_filed": "Oposição|Contestação|Oposição\\s*apresentada",
    "renewal": "Renovação|Pagamento\\s*da\\s*anuidade|Pagamento\\s*de\\s*taxa",
    "lapse": "Caducidade|Extinção|Caducidade\\s*declarada|Extinção\\s*de\\s*registo",
    "transfer": "Transmissão|Cessão|Alteração\\s*de\\s*titular",
    "change_name": "Alteração\\s*de\\s*denominação|Mudança\\s*de\\s*nome|Alteração\\s*de\\s*nome",
}


def heading_lines(text: Column, kinds: tuple[str, ...] = tuple(HEADINGS)) -> Column:
    """Array of (line, context) of a page's lines that match a heading; the context is the line and those after it."""

    def found(page: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(page) - 1), lambda i: F.element_at(page, i + 1).rlike(_any_of(kinds)))
        return F.transform(at, lambda i: F.struct(F.element_at(page, i + 1).alias("line"), F.slice(page, i + 1, LOOK_AHEAD).alias("context")))

    return bind(lines(text), found)


def _any_of(kinds: tuple[str, ...]) -> str:
    return f"(?iu)(?:{'|'.join(HEADINGS[k] for k in kinds)})"


def bulletin_events(documents: DataFrame, number: str = NUMBER, kinds: tuple[str, ...] = tuple(HEADINGS)) -> DataFrame:
    """Events of bulletins (doc_id, pages, bulletin_date); pages count from 1, blank ones and short documents give none.

    Pages without a heading are filtered first. Lines with one become rows, so the number is searched for in their context only
    and the headings are told apart in generated code.
    """
    long_enough = documents.where(F.length(F.trim(F.array_join("pages", "\n"))) >= LEAST_TEXT)
    pages = long_enough.select("doc_id", "bulletin_date", F.posexplode("pages").alias("pos", "page_text")).where((F.trim("page_text") != "") & F.col("page_text").rlike(_any_of(kinds)))
    heads = pages.select("doc_id", F.col("bulletin_date").alias("event_date"), (F.col("pos") + 1).alias("page_number"), F.inline(heading_lines(F.col("page_text"), kinds)))
    # The context is searched as one text whose lines a NUL keeps apart, so the first hit is that of the first line that has one.
    joined = F.array_join(F.transform("context", lambda x: F.replace(x, F.lit("\0"), F.lit(" "))), "\0")
    hit = F.regexp_extract(joined, number.replace(r"\S", r"[^\s\x00]"), 1)
    numbered = heads.withColumn("_hit", hit).where("_hit <> ''")
    types = F.explode(F.array_compact(F.array(*[F.when(F.col("line").rlike(f"(?iu)(?:{HEADINGS[k]})"), F.lit(k)) for k in kinds])))
    out = numbered.select(
        "doc_id", "event_date", "page_number", types.alias("event_type"), F.regexp_replace("_hit", r"\s+", "").alias("application_number"),
        F.substring(F.trim(F.array_join("context", " | ")), 1, 1000).alias("excerpt"), F.substring("line", 1, 300).alias("raw_text"),
    )
    return out.withColumns({"description": F.substring("excerpt", 1, 500), "confidence_score": event_confidence(F.col("event_type"), F.col("application_number"), F.col("excerpt"), F.col("event_date").isNotNull())})


def route_events(events: DataFrame, marks: DataFrame, known: DataFrame, enabled: bool = True) -> DataFrame:
    """The fate of each event: dropped, review (no number, unmatched, doubtful), duplicate, or insert.

    marks: application_number, mark_id; known: mark_id, event_type, event_date. Of equal events in the
    batch the first is inserted. A publication opens an opposition deadline two months later.
    """
    from pyspark.sql import Window

    joined = events.join(marks, "application_number", "left")
    # Only events with a mark are compared; those that are known come first among their equals, in the one shuffle that orders them.
    old = known.where("mark_id is not null and event_type is not null").select("mark_id", "event_type", "event_date").distinct().withColumn("_old", F.lit(True))
    compared = joined.where("mark_id is not null").withColumn("_old", F.lit(False)).unionByName(old, allowMissingColumns=True)
    equals = Window.partitionBy("mark_id", "event_type", "event_date").orderBy(F.desc("_old"), "doc_id", "page_number", "raw_text")
    turned = compared.withColumn("_turn", F.row_number().over(equals)).where("not _old").drop("_old")
    seen = turned.unionByName(joined.where("mark_id is null").withColumn("_turn", F.lit(0)))
    route = (
        F.when(F.lit(not enabled), "dropped")
        .when(F.coalesce("application_number", F.lit("")) == "", "review_no_number")
        .when(F.col("mark_id").isNull(), "review_unmatched")
        .when(F.col("confidence_score") < REVIEW_THRESHOLD, "review_confidence")
        .when(F.col("_turn") > 1, "duplicate")
        .otherwise("insert")
    )
    opens = F.when((route == "insert") & (F.col("event_type") == "publication"), F.add_months("event_date", 2))
    return seen.select(*events.columns, "mark_id", route.alias("route"), opens.alias("opposition_due"))
