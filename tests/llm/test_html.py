"""Whole extraction on generated hosts, with and without article elements, against plain line lists."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html


def longest_common(a, b):
    """Number of lines of a longest common subsequence, by the full table."""
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def hosts():
    """(id, url, html, article lines, lines kept by nobody) of pages whose lines are known."""
    rng = np.random.default_rng(4)
    pages, k = [], 0
    for host in range(4):
        site = [f"Site {host}", "All articles", "Contact us"]
        tail = [f"Copyright {host}", "Imprint"]
        for n in range(12):
            body = [f"line {host} {n} {j} " + " ".join(f"w{x}" for x in rng.integers(0, 50, 6)) for j in range(int(rng.integers(1, 6)))]
            if host == 1:  # articles that neighbours quote
                body.insert(0, "A line that every article of this host quotes")
            if host == 2 and 3 <= n < 9:  # a run of copies
                body = ["the same story", "told six times"]
            blocks = lambda lines: "".join(f"<p>{x}</p>" for x in lines)
            if host < 2:
                text = f"<body>{blocks(site)}<article>{blocks(body)}<ul><li><a href='/a'>Menu {host}</a></li></ul></article>{blocks(tail)}</body>"
            else:
                text = f"<body>{blocks(site)}<div>{blocks(body)}</div>{blocks(tail)}</body>"
            pages.append((k, f"http://host{host}.example/{n:02d}/story", text, body))
            k += 1
    return pages


def test_extraction_on_generated_hosts(spark):
    pages = hosts()
    df = spark.createDataFrame([(*p[:3], 1, "x") for p in pages], "page_id long, url string, html string, n int, near string")
    got = {r.page_id: r.text for r in html.extract_pages(df).collect()}
    assert got == {k: " ".join(body) for k, _, _, body in pages}


def test_differencing_decides(spark):
    """Without neighbours the site's lines and the articles' menus stay; each host's first page shows it."""
    for k, _, text, body in hosts()[::12]:
        alone = html.main_text(text, None)
        assert alone != " ".join(body) and all(x in alone for x in body), k


def test_nearest_page_that_differs_across_ranges(spark):
    """Runs of copies over several ranges: the neighbours are those of a plain loop over the sorted pages."""
    rng = np.random.default_rng(2)
    rows = [(k, f"http://h{k // 60}/{k:04d}", "".join(f"<p>{x}</p>" for x in (["same", "lines"] if 20 <= k % 60 < 50 else [f"own {k}", f"more {rng.integers(9)}"]))) for k in range(120)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        near = {r.page_id: r.near for r in html.nearest_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    lines = [html._line_hashes(html.page_lines(r[2])) for r in rows]
    path = [r[1].split("/", 3)[3] for r in rows]
    for k in range(120):
        own = [j for j in range(k // 60 * 60, k // 60 * 60 + 60) if lines[j] != lines[k]]
        before, after = max((j for j in own if j < k), default=None), min((j for j in own if j > k), default=None)
        common = lambda j: next((i for i, (x, y) in enumerate(zip("/" + path[k], "/" + path[j], strict=True)) if x != y), 99)
        want = after if before is None or (after is not None and common(after) > common(before)) else before
        assert near[k] == lines[want], k


def test_split_alignments_are_longest():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(0, 40)).tolist(), rng.integers(0, 5, rng.integers(0, 40)).tolist()
        got = html.common_lines(a, b, table_bits=30)
        rest = iter(b)
        assert len(got) == longest_common(a, b) and all(a[i] in rest for i in got) and got == sorted(set(got))


def test_very_long_pages(spark):
    """A page of 60,000 lines against a neighbour that shares every other one."""
    site = lambda name: "".join(f"<p>{name if k % 2 else 'shared'} {k}</p>" for k in range(60_000))
    df = spark.createDataFrame([(1, "http://h/1", site("one")), (2, "http://h/2", site("two"))], "page_id long, url string, html string")
    got = html.extract_pages(df).withColumn("shared", F.expr("text like '%shared%'")).select("page_id", "n_chars", "shared").collect()
    assert {(r.page_id, r.shared, r.n_chars) for r in got} == {(k, False, len(" ".join(f"{n} {j}" for j in range(1, 60_000, 2)))) for k, n in ((1, "one"), (2, "two"))}


KEPT = [
    ("<article><h2 id='discussion'>Why</h2><p>Body one.</p><section id='related-work'>Others did.</section><p class='notice-period'>Thirty days.</p><div class='code-widget'>x = 1</div><p>End.</p></article>", "Why Body one. Others did. Thirty days. x = 1 End."),
    ("<article><p>a <a href=x title=don't>link</a> tail it's done</p><p>next</p></article>", "a link tail it's done next"),
    ("<p>a <a href=x title=don't>link</a> tail it's done</p><p>next</p>", "a link tail it's done next"),
    ("<article class='post comments-open'><h1 class='header'>T</h1><p class='share'>Text.</p><section id='discussion'><h2>Discussion</h2>We say.</section></article>", "T Text. Discussion We say."),
    ("<main><div class='table-header'>Head</div><div id='notices-of-war'>War.</div><table class='ad-free'><tr><td>1</td></tr></table></main>", "Head War. 1"),
    ("<article><p>In.</p><div class='ad'>Buy</div><div class='social-share'>Share</div><section class='comments'><h3>Readers</h3>No!</section><article class='comment-7'>Me too</article><aside>Side</aside></article>", "In."),
    ("<article><p>One <a title=\"x > y\" data-x='>'>two</a> three</p><p title='a=\"b'>four</p><p x=\"un>five</p></article>", "One two three four five"),
]


@pytest.mark.parametrize("page, text", KEPT)
def test_article_text_is_whole(page, text):
    assert html.main_text(page, None) == text


def plain_extraction(tree):
    """Text of a tree of (tag, name, children) by plain recursion: what stands in the article and in no dropped element."""
    out = []

    def walk(node, inside, dropped):
        tag, name, children = node
        inside = inside or tag == "article"
        dropped = dropped or tag in ("nav", "aside", "footer", "form", "script") or name in ("ad", "newsletter", "social-share")
        for c in children:
            if isinstance(c, str):
                out.extend([c] if inside and not dropped else [])
            else:
                walk(c, inside, dropped)

    walk(tree, False, False)
    return " ".join(out)


def test_extraction_of_random_trees():
    """Random nested pages against the recursion above."""
    rng = np.random.default_rng(9)
    tags = ["div", "section", "ul", "nav", "aside", "footer", "form", "div", "div", "blockquote"]
    names = ["", "", "ad", "body-text", "related-work", "newsletter", "notice-period", "social-share"]
    number = iter(range(10**6))

    def tree(depth):
        tag = str(rng.choice(tags)) if depth else "div"
        name = str(rng.choice(names)) if tag == "div" else ""
        kids = [tree(depth + 1) if depth < 4 and rng.random() < 0.5 else ("p", "", [f"text {next(number)}"]) for _ in range(int(rng.integers(1, 4)))]
        return tag, name, kids

    def written(node):
        tag, name, children = node
        return f"<{tag}{f' class={name}' if name else ''}>" + "".join(c if isinstance(c, str) else written(c) for c in children) + f"</{tag}>"

    for _ in range(300):
        page = ("body", "", [tree(1), ("article", "", [("h1", "", ["Title"]), tree(1), tree(1)]), ("footer", "", ["end"])])
        assert html.main_text(written(page), None) == plain_extraction(page)


@pytest.mark.parametrize("part", ["<span>x</i>", "</i>", "<div><b>", "<p><span>", "<li><i>", "<a title=don't", "<a x=\"", "<ul><li>", "<header><i>x"])
def test_odd_markup_takes_linear_time(part):
    began = time.time()
    html.main_text("<article>" + part * (1_000_000 // len(part)), None)
    assert time.time() - began < 8
