"""Registry sources: paged JSON envelopes, search expressions, a fixture search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_PAGE, MOST_PAGE = 10, 100


def page_size(asked: int) -> int:
    return max(LEAST_PAGE, min(MOST_PAGE, asked))


def search_expression(word: str | None = None, jurisdiction: str | None = None, classes: list[int] | None = None, since: str | None = None) -> str:
    """The predicate text that the registry's search takes; parts that aren't given are left out."""
    parts = []
    if word:
        parts.append(f"wordMark==*{word}*")
    if jurisdiction:
        parts.append(f"jurisdiction=={jurisdiction}")
    if classes:
        parts.append(f"niceClass=in=({','.join(map(str, classes))})")
    if since:
        parts.append(f"updateDate=ge={since}")
    return ";".join(parts)


def unwrapped(body: dict | list) -> list:
    """The records of a response: its results or trademarks, a bare list, else none."""
    if isinstance(body, list):
        return body
    return next((body[k] for k in ("results", "trademarks") if isinstance(body.get(k), list)), []) if isinstance(body, dict) else []


def enveloped(body: Column) -> Column:
    """Struct of a response body: its records (array of variants; null: no envelope) and totalPages."""
    v = F.try_parse_json(body)
    lists = [F.try_variant_get(v, path, "array<variant>") for path in ("$.results", "$.trademarks", "$")]
    known = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array().cast("array<variant>"))
    return F.struct(F.coalesce(*lists, known).alias("records"), F.try_variant_get(v, "$.totalPages", "int").alias("total_pages"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page (the number in its file name) and body of the JSON files under ``path``, read by Spark from any store."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"(\d+)\.json$", 1).cast("int").alias("page"), F.col("value").alias("body"))
    return files


def poll(pages: DataFrame, size: int = 50, max_pages: int = 20) -> tuple[DataFrame, dict]:
    """The records (page, place, record as JSON) of the pages (page from 0, body) that a poll reads, and how it ended.

    The poll ends after a short page, after the last of totalPages, or at the cap; the outcome names the
    pages read, whether that was all, and the page at which the next poll starts (None: none is left). A body
    that is no envelope and a page with more records than were asked for are errors.
    """
    wanted = page_size(size)
    opened = pages.select("page", enveloped(F.col("body")).alias("e")).select("page", F.col("e.records").alias("records"), F.col("e.total_pages").alias("total"))
    n = F.size("records")
    wrong = F.when(F.col("records").isNull(), F.lit("no envelope")).when(n > wanted, F.concat(n.cast("string"), F.lit(f" records where {wanted} were asked for")))
    last = F.when((n < wanted) | (F.col("page") + 1 >= F.col("total")), F.col("page"))
    ends = opened.where(F.col("page") < max_pages).agg(F.min(last).alias("last"), F.max("page").alias("top"), F.min(F.when(wrong.isNotNull(), F.struct("page", wrong.alias("why")))).alias("wrong")).first()
    top = ends["top"] if ends["last"] is None else ends["last"]
    if ends["wrong"] is not None and ends["wrong"]["page"] <= top:
        raise ValueError(f"page {ends['wrong']['page']}: {ends['wrong']['why']}")
    read = 0 if top is None else top + 1
    records = opened.where(F.col("page") < read).select("page", F.posexplode("records").alias("place", "record")).select("page", "place", F.to_json("record").alias("record"))
    done = ends["last"] is not None or read < max_pages
    return records, {"pages": read, "complete": done, "next_page": None if done else read}


def detail(records: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """key and record of the asked ``keys`` (key), by the first of the ``names`` that a record has."""
    v = F.parse_json("record")
    own = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])
    return records.withColumn("key", own).join(keys.select("key").distinct(), "key").select("key", "record")


def fixture_search(marks: DataFrame, text: str, columns: tuple[str, ...] = ("word_mark", "application_number")) -> DataFrame:
    """Rows that contain the text in a column; all rows when none does."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    found = marks.agg(F.coalesce(F.max(hit), F.lit(False))).first()[0]
    return marks.where(hit) if found else marks
