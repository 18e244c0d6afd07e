"""Bulletin queries; a bulletin is synthesised from each order's lines, in the query and in its SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators.bulletin import HEADINGS, bulletin_events, route_events
from tidemark.plans.base import query
from tidemark.sources.documents import file_pages
from tidemark.sources.staging import staged

_WORDS = {0: "Despacho de Publicação n. 12", 1: "Concessão do registo", 2: "Recusa provisória", 3: "Renovação", 4: "Texto livre", 5: "Caducidade declarada e Transmissão", 6: "MUDANÇA DE NOME"}


def _bulletins(read):
    orders = read("orders")
    k = F.col("o_orderkey")
    head = F.create_map(*[F.lit(x) for kv in _WORDS.items() for x in kv])
    page = F.concat(head[(k % 7).cast("int")], F.lit("\nTitular: Cliente "), F.col("o_custkey").cast("string"), F.when(k % 4 == 0, F.lit("\nsem número")).otherwise(F.concat(F.lit("\nNº de pedido: N-"), F.lpad(k.cast("string"), 6, "0"))), F.lit("\nFim da entrada do boletim oficial"))
    return orders.select(k.alias("doc_id"), F.array(page, F.lit(" ")).alias("pages"), F.to_date("o_orderdate").alias("bulletin_date"))


_HEAD = "CASE (o_orderkey % 7) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _WORDS.items()) + " END"
_SQL_EVENTS = f"""WITH pages AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS event_date, {_HEAD} || chr(10) || 'Titular: Cliente ' || o_custkey || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || 'sem número' ELSE chr(10) || 'Nº de pedido: N-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') END || chr(10) || 'Fim da entrada do boletim oficial' AS t FROM orders),
ls AS (SELECT doc_id, event_date, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i, string_split(t, chr(10)) AS ls FROM pages),
ctx AS (SELECT *, ls[i:i + 7] AS c FROM ls),
num AS (SELECT *, list_filter(list_transform(c, lambda x: regexp_extract(x, '(?i)(?:N[º°]\\s*de\\s*pedido|N[º°]\\.?\\s*Pedido|Application\\s*No|Processo)[\\s:]*(\\S+)', 1)), lambda n: n <> '')[1] AS application_number, trim(array_to_string(c, ' | '))[1:1000] AS excerpt FROM ctx),
ev AS (SELECT n.*, h.event_type FROM num n JOIN (VALUES {", ".join(f"('{k}', '(?i)(?:{v})')" for k, v in HEADINGS.items())}) AS h(event_type, p) ON regexp_matches(n.line, h.p) WHERE application_number IS NOT NULL),
events AS (SELECT doc_id, event_date, 1 AS page_number, event_type, application_number, excerpt, line AS raw_text, excerpt[1:500] AS description,
    0.25::DOUBLE + CASE WHEN regexp_matches(application_number, '(?i)^(?:[A-Z]{{1,3}}[-/ ]?)?\\d{{4,8}}$') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.4::DOUBLE + CASE WHEN length(excerpt) >= 40 THEN 1.0::DOUBLE WHEN length(excerpt) >= 10 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END * 0.2::DOUBLE + 0.15::DOUBLE AS confidence_score FROM ev)"""


@query("bulletin_events", f"{_SQL_EVENTS} SELECT doc_id, event_date, page_number, event_type, application_number, raw_text, description, round(confidence_score, 6) AS confidence_score FROM events")
def events(read):
    """Events by heading pattern with the number of the next eight lines."""
    return bulletin_events(_bulletins(read)).select("doc_id", "event_date", "page_number", "event_type", "application_number", "raw_text", "description", F.round("confidence_score", 6).alias("confidence_score"))


@query("bulletin_grants", f"{_SQL_EVENTS} SELECT doc_id, event_type, application_number FROM events WHERE event_type = 'grant'")
def grants(read):
    """The extractor of one event type."""
    return bulletin_events(_bulletins(read), kinds=("grant",)).select("doc_id", "event_type", "application_number")


@query(
    "bulletin_routing",
    f"""{_SQL_EVENTS},
marks AS (SELECT 'N-' || lpad(CAST(l_orderkey AS VARCHAR), 6, '0') AS application_number, min(l_partkey) AS mark_id FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey),
known AS (SELECT m.mark_id, e.event_type, e.event_date FROM events e JOIN marks m USING (application_number) WHERE e.doc_id % 5 = 1),
r AS (SELECT e.*, m.mark_id, EXISTS (SELECT 1 FROM known k WHERE k.mark_id = m.mark_id AND k.event_type = e.event_type AND k.event_date = e.event_date) AS old, row_number() OVER (PARTITION BY m.mark_id, e.event_type, e.event_date ORDER BY doc_id, page_number, raw_text) AS turn FROM events e LEFT JOIN marks m USING (application_number)),
f AS (SELECT *, CASE WHEN mark_id IS NULL THEN 'review_unmatched' WHEN confidence_score < 0.6 THEN 'review_confidence' WHEN old OR turn > 1 THEN 'duplicate' ELSE 'insert' END AS route FROM r)
SELECT doc_id, event_type, mark_id, route, CASE WHEN route = 'insert' AND event_type = 'publication' THEN CAST(event_date + INTERVAL 2 MONTH AS DATE) END AS opposition_due FROM f""",
)
def routing(read):
    """Where each event goes."""
    needed = ["doc_id", "event_date", "page_number", "event_type", "application_number", "raw_text", "confidence_score"]
    found = staged(bulletin_events(_bulletins(read)).select(*needed), "events")  # read three times
    number = F.concat(F.lit("N-"), F.lpad(F.col("l_orderkey").cast("string"), 6, "0"))
    marks = read("lineitem").where("l_orderkey % 3 <> 0").groupBy("l_orderkey").agg(F.min("l_partkey").alias("mark_id")).select(number.alias("application_number"), "mark_id")
    known = found.where("doc_id % 5 = 1").join(marks, "application_number").select("mark_id", "event_type", "event_date")
    return route_events(found, marks, known).select("doc_id", "event_type", "mark_id", "route", "opposition_due")


_MAP = zlib.compress(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange")


def pdf_of(pages: list[list[str]]) -> bytes:
    """A PDF file that shows the lines of each page; codes of its font are UTF-16."""
    def made(number: int, head: str, body: bytes | None = None) -> bytes:
        return f"{number} 0 obj\n<< {head} >>\n".encode() + (b"" if body is None else b"stream\n" + body + b"\nendstream\n") + b"endobj\n"

    out = [b"%PDF-1.7\n", made(1, "/Type /Catalog /Pages 2 0 R"), made(3, "/Type /Font /Subtype /Type0 /ToUnicode 4 0 R"), made(4, f"/Filter /FlateDecode /Length {len(_MAP)}", _MAP)]
    for k, page in enumerate(pages):
        shown = "BT /F 9 Tf 40 800 Td " + " ".join(f"0 -11 Td <{line.encode('utf-16-be').hex()}> Tj" for line in page) + " ET"
        body = zlib.compress(shown.encode())
        out += [made(5 + 2 * k, f"/Type /Page /Parent 2 0 R /Contents {6 + 2 * k} 0 R"), made(6 + 2 * k, f"/Filter /FlateDecode /Length {len(body)}", body)]
    kids = " ".join(f"{5 + 2 * k} 0 R" for k in range(len(pages)))
    return b"".join([*out, made(2, f"/Type /Pages /Count {len(pages)} /Kids [{kids}] /Resources << /Font << /F 3 0 R >> >>"), b"trailer << /Root 1 0 R >>\n%%EOF"])


@query(
    "pdf_pages",
    """WITH l AS (SELECT p_partkey // 500 AS file, p_partkey % 500 AS i, 'Nº ' || p_partkey || ' ' || p_name AS line FROM part)
SELECT file, (i // 50 + 1)::INT AS page_number, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY ALL""",
)
def pdf_pages_of_parts(read):
    """The page texts of PDF files, each with five hundred parts, fifty a page."""
    k = F.col("p_partkey")
    line = F.struct((k % 500).alias("i"), F.concat(F.lit("Nº "), k.cast("string"), F.lit(" "), "p_name").alias("line"))
    files = read("part").groupBy(F.floor(k / 500).alias("file")).agg(F.array_sort(F.collect_list(line)).alias("lines")).select("file", F.transform("lines", lambda x: x["line"]).alias("lines"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pdf_of([lines[k : k + 50] for k in range(0, len(lines), 50)]) for lines in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["file", "content"])

    read_back = file_pages(files.mapInArrow(written, "file long, content binary"))
    return read_back.select("file", F.posexplode("pages").alias("k", "text")).select("file", (F.col("k") + 1).alias("page_number"), "text")
