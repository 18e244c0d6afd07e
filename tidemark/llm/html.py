"""Main text of web pages: structure and nearest-URL page differencing.

A page is read into lines (its blocks) with what surrounds them: scripts, menus, page headers and
footers, forms, adverts, notices, sidebars and reader comments are known by element, role, class or id.
Pages of a host are put in the order of their URL paths; each page is paired with the neighbour whose
path shares the longer prefix, the lines of both are aligned by a longest common subsequence, and shared
lines are deleted. A neighbour with the same lines is a copy and tells nothing, so the nearest page that
differs is taken. Inside an ``article`` or ``main`` element a shared line is deleted only if it is an item of
a list and all link (a menu): neighbours quote and copy each other's articles, so text there is the author's.

Only line hashes are paired. They are range-partitioned by (host, path), so a host with a third of all
pages spreads over tasks; the neighbours at the edges of ranges come from a table with two rows a range.

Nulls: null html is empty and gives an empty text; a null or odd URL belongs to the empty host. Rows that
repeat a page_id and url share one pairing, that of the row with the least lines. Very long pages are read
whole; the alignment keeps memory in proportion to their lines (Hirschberg's split over bit-parallel rows).
An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import read_table, stage_table

# HTML's void elements, its elements whose content is not markup, and its block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|noscript|template|iframe|svg|math|title|select|object|canvas|video|audio|noframes|xmp"
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html head td th tr tbody thead tfoot caption option legend".split())
DROPPED = frozenset("head nav footer aside form button menu dialog dir frameset fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay "
    "share sharing social comment comments respond reply replies disqus discussion sidebar widget widgets menu nav navigation navbar breadcrumb breadcrumbs footer masthead toolbar related recommended login search pagination pager copyright disclaimer".split()
)
HEADER_HINTS = frozenset("header topbar".split())
COMMENTS = frozenset("comment comments respond reply replies disqus discussion".split())
#: Elements that a hint can take out of an article: never its headings and paragraphs, and a section only for readers' comments.
CONTAINERS = frozenset("div ul ol dl table span ins a details".split())
TEXT_BLOCKS = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption".split())

#: Largest table of an alignment that is kept whole, in bits (1 MiB).
TABLE_BITS = 8 << 20

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*(?<!/)>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _marks(attrs: str) -> tuple[list[set[str]], bool]:
    """The words of each class and id; whether the element is hidden or has a role outside the article."""
    names: list[set[str]] = []
    out = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id"):
            names += [{w.lower() for w in _NAME_WORDS.findall(v)} for v in value.split()]
        elif name == "role":
            out |= value.strip().lower() in DROPPED_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            out = True
    return [n for n in names if n], out


def _hinted(tag: str, names: list[set[str]], article: bool, hints: frozenset[str]) -> bool:
    """Whether the names say that the element is not the article.

    Inside an article, and on blocks of text, only a name that consists of hints counts (``related-work`` does not).
    """
    if tag in ("html", "body") or not names:
        return False
    if tag in ("article", "main") or (article and tag == "section"):
        return any(n <= COMMENTS - {"discussion"} for n in names)
    if article:
        return tag in CONTAINERS and any(n <= hints for n in names)
    return any(n <= hints for n in names) if tag in TEXT_BLOCKS else any(n & hints for n in names)


def page_lines(html: str | None) -> list[tuple[str, bool, bool]]:
    """The lines outside of dropped elements: (text, inside an article, a list item that is all link)."""
    # Each open element: name, dropped, by a hint only, inside an article, inside a header, inside a link.
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = [("", False, False, False, False, False)]
    lines: list[tuple[str, bool, bool]] = []
    held: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    inside = item = False

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(t for t, _ in held)).split())
            if text:
                lines.append((text, inside, item and all(linked or not t.strip() for t, linked in held)))
            held.clear()

    def pop_to(k: int) -> None:
        if any(x[0] in BLOCK for x in stack[k:]):
            flush()
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def put(text: str) -> None:
        nonlocal inside, item
        top = stack[-1]
        if text and not top[1] and not (top[4] and not any(opened[h] for h in HEADINGS)):
            if not held:
                inside, item = top[3], opened["li"] > 0
            held.append((text, top[5]))

    source = html or ""
    at = 0
    for m in _TOKEN.finditer(source):
        put(source[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if opened[tag] > 0:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            # An open paragraph or item ends where the next block or item begins.
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
            may_end = (tag in CLOSES_P and opened["p"] > 0) or any(opened[e] > 0 for e in ends)
            for k in range(len(stack) - 1 if may_end else 0, 0, -1):
                if stack[k][0] in ends or stack[k][0] == "p" and tag in CLOSES_P:
                    pop_to(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "article", "main", "section", "div", "body"):
                    break
        _, dropped, soft, article, header, link = stack[-1]
        names, out = _marks(m["attrs"]) if m["attrs"].strip() else ([], False)
        own = tag in ("article", "main")
        hinted = _hinted(tag, names, article, HINTS)
        if own and not hinted and not out:
            article = True
            dropped, soft = dropped and not soft, False
        header = (header or tag == "header" or (not own and tag not in HEADINGS and _hinted(tag, names, article, HEADER_HINTS))) and not (own and not hinted)
        if tag in DROPPED or out or (tag == "header" and not article):
            dropped, soft = True, False
        elif hinted and not dropped:
            dropped, soft = True, not any(n & COMMENTS for n in names)
        opened[tag] += 1
        stack.append((tag, dropped, soft, article, header, link or tag == "a"))
    put(source[at:])
    flush()
    return lines


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Rows of the alignment of ``a`` with ``b`` as integers: a zero bit j says that line j of b makes the subsequence longer."""
    place: dict[int, int] = {}
    for j, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    yield row
    for x in a:
        hit = row & place.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _traced(a: list[int], b: list[int]) -> list[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``, from the whole table."""
    rows = list(_rows(a, b))
    out = []
    i, j = len(a), len(b)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i] & bit:
            j -= 1
        elif not rows[i - 1] & bit:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``."""
    row = 0
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


def common_lines(a: list[int], b: list[int], table_bits: int = TABLE_BITS) -> list[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``.

    Tables over ``table_bits`` bits are halved at the place of ``b`` through which a longest subsequence goes.
    """
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a1 - a0 < 2 or (a1 - a0) * (b1 - b0) <= table_bits:
            out += [a0 + i for i in _traced(a[a0:a1], b[b0:b1])]
            continue
        mid = (a0 + a1) // 2
        split = b0 + int(np.argmax(_lengths(a[a0:mid], b[b0:b1]) + _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]))
        todo += [(mid, a1, split, b1), (a0, mid, b0, split)]
    return out


def _line_hashes(lines: list[tuple[str, bool, bool]]) -> list[int]:
    return [xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, _, _ in lines]


def main_text(html: str | None, neighbour: list[int] | None) -> str:
    """The article's text, given the line hashes of the nearest page."""
    lines = page_lines(html)
    shared = set(common_lines(_line_hashes(lines), neighbour)) if neighbour and lines else set()
    if any(inside for _, inside, _ in lines):
        return " ".join(t for k, (t, inside, item) in enumerate(lines) if inside and not (item and k in shared))
    return " ".join(t for k, (t, _, _) in enumerate(lines) if k not in shared)


def nearest_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and the line hashes of the page with other lines nearest by path on the same host (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hashes = [_line_hashes(page_lines(h)) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(hashes, pa.list_(pa.int64()))], ["page_id", "url", "hashes"])

    hashed = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, hashes array<long>")
    place = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)"
    keyed = stage_table(
        hashed.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", place, 1), F.lit("")))).withColumn("path", F.coalesce(F.regexp_extract("url", place, 2), F.lit(""))),
        "page-lines",
    )
    order = ["host", "path", "url", "page_id", "hashes"]
    ranged = stage_table(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "page-ranges")
    ranged = ranged.withColumn("range", F.shiftright("pos", 33))
    page = F.struct("host", "path", "hashes")
    ranged = ranged.select("page_id", "url", "host", "path", "range", "pos", page.alias("page"))

    def unlike(rows: DataFrame, keys: list[str], order: Column, name: str) -> DataFrame:
        """``name``: the last page before, in that order, whose lines differ from the row's."""
        part = Window.partitionBy(*keys).orderBy(order)
        last = F.lag("page").over(part)
        marked = rows.withColumn("_last", last).withColumn("_turn", F.when(F.col("_last").isNotNull() & (F.col("_last")["hashes"] != F.col("page")["hashes"]), F.col("_last")))
        return marked.withColumn(name, F.last("_turn", ignorenulls=True).over(part)).drop("_last", "_turn")

    sides = unlike(unlike(ranged, ["range"], F.col("pos"), "before"), ["range"], F.col("pos").desc(), "after")
    # What lies beyond a range: its neighbour's edge page, and for copies of that page the one before with other lines.
    edges = stage_table(sides.groupBy("range").agg(*[f(F.struct("page", "before", "after"), "pos").alias(n) for f, n in ((F.min_by, "first"), (F.max_by, "last"))]), "page-edges")
    ends = []
    for edge, inner, order in (("last", "before", F.col("at")), ("first", "after", F.col("at").desc())):
        # Two rows a range: the page that differs from its edge page, then the edge page.
        two = F.array(F.struct(F.col(edge)[inner].alias("page"), (F.col("range") * 2 + (0 if edge == "last" else 1)).alias("at")), F.struct(F.col(edge)["page"].alias("page"), (F.col("range") * 2 + (1 if edge == "last" else 0)).alias("at")))
        seen = unlike(edges.select(F.inline(two)).where("page is not null"), [], order, "other")
        step = Window.orderBy(order)
        rows = seen.withColumn("next", F.lead("at").over(step)).where(F.shiftright("at", 1) != F.coalesce(F.shiftright("next", 1), F.lit(-1)))
        ends.append(rows.select((F.shiftright("next", 1)).alias(f"_{inner}_range"), F.struct("page", "other").alias(f"{inner}_range")).where(F.col(f"_{inner}_range").isNotNull()))
    sides = sides.join(ends[0], F.col("range") == F.col("_before_range"), "left").join(ends[1], F.col("range") == F.col("_after_range"), "left")
    for inner in ("before", "after"):
        beyond = F.col(f"{inner}_range")
        sides = sides.withColumn(inner, F.coalesce(F.col(inner), F.when(beyond["page"]["hashes"] != F.col("page")["hashes"], beyond["page"]).otherwise(beyond["other"])))
    sides = sides.withColumn("n", F.size(F.col("page")["hashes"]))
    # Length of the common prefix of two paths: the first position at which they differ.
    common = lambda other: F.coalesce(F.array_position(F.zip_with(F.split("path", ""), F.split(other, ""), lambda x, y: ~x.eqNullSafe(y)), True), F.lit(1 << 30))
    rank = lambda side: F.when(F.col(side)["host"] == F.col("host"), F.when(common(F.col(side)["path"]) == 0, F.lit(1 << 30)).otherwise(common(F.col(side)["path"])))
    chosen = F.when(F.coalesce(rank("after"), F.lit(-1)) > F.coalesce(rank("before"), F.lit(-1)), F.col("after")["hashes"]).when(rank("before").isNotNull(), F.col("before")["hashes"])
    return sides.select("page_id", "url", "n", chosen.alias("near")).groupBy("page_id", "url").agg(F.min(F.struct("n", "near"))["near"].alias("near"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    near = nearest_pages(pages).withColumnsRenamed({"page_id": "_page", "url": "_url"})
    joined = pages.select("page_id", "url", "html").join(near, F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url")), "left").select("page_id", "url", "html", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(h, n) for h, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(read_table(spark, folder, "pages"))


QUERIES = {"op7_html": op7_html}
ORACLES: dict[str, str] = {}
