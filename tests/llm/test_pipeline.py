"""Each stage against a brute-force version, on the small tables and on odd rows: nulls in every column, empty and
very long texts, ties, repeated rows, clashing column names, an empty table."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, pieces
from tidemark.llm.common import read_table
from tidemark.llm.quality import FENCE, GRID, LEAST_GROUP, RULES

STAGES = dict(corpus_pipeline.STAGES)
EXTRA = ("counts", "group_lang", "group_source", "group_quartiles", "gone", "passages", "passage_doc", "emptied", "row", "facts", "times", "copy", "taken_row", "piece_ids", "size", "key", "m", "bucket")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("ra", "lum", "tek", "no", "sed", "vi")]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = text(30)
    rows = [(k, text(int(rng.integers(25, 90))), ("en", "de")[k % 2], ("a", "b", "c")[k % 3]) for k in range(70)]
    rows += [(100 + k, f"{text(30)} {passage} {text(30)}", "en", "a") for k in range(5)]
    near = text(120).split()
    rows += [(200 + k, " ".join([*near[:k], "changed", *near[k + 1 :]]), "en", "b") for k in range(6)]
    rows += [(300, rows[3][1], "en", "a"), (301, rows[3][1], "en", "a"), (302, rows[3][1].upper(), "en", "b")]
    rows += [(400, "", "en", "a"), (401, None, None, None), (None, text(50), None, "c"), (None, text(50), "fr", None), (402, " \n\t ", "de", "b")]
    rows += [(500, "%$# " * 40 + text(30), "en", "a"), (501, ("same line here\n" * 30) + text(40), "en", "a")]
    rows += [(600, text(60), "de", "c")] * 2 + [(601, " ".join(f"u{k}x{k * 7}" for k in range(25_000)), "en", "a")]
    frame = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.createDataFrame(frame.withColumns({c: F.lit(k) for k, c in enumerate(EXTRA)}).collect(), frame.withColumns({c: F.lit(1) for c in EXTRA}).schema)


@pytest.fixture(scope="module", params=["odd rows", "small table"])
def docs(request, spark, sf_dir, odd):
    return odd if request.param == "odd rows" else read_table(spark, sf_dir, "documents")


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def facts(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    t = text or ""
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
        "n_repeat_words": len(hit), "n_upper": sum("A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") for c in t), "n_marks": sum(c in "!?" for c in t),
    }


def quartile(values, q):
    ordered = sorted(values)
    return ordered[max(0, -(-len(ordered) * q // 4) - 1)]


def test_quality_rules(spark, docs):
    rows = [(r, facts(r.text)) for r in docs.collect()]
    passed = [(r, f) for r, f in rows if f["n_words"] >= 20 and 100 * f["n_repeat_words"] <= 30 * f["n_words"]]

    def share(f, rule):
        count, whole, unit, _, event = RULES[rule]
        return unit * (f[count] + event) // (f[whole] + event) if f[whole] + event else 0

    want = Counter()
    for r, f in passed:
        good = True
        for rule, (count, _, _, side, _) in RULES.items():
            levels = ([g for x, g in passed if (x.lang, x.source) == (r.lang, r.source)], [g for x, g in passed if x.lang == r.lang], [g for _, g in passed])
            group = next((level for level in levels if len(level) >= LEAST_GROUP), levels[2])
            bins = [min(share(g, rule), GRID) for g in group]
            low, high = quartile(bins, 1), quartile(bins, 3)
            room = FENCE * (high - low)
            good &= not f[count] or (share(f, rule) <= high + room and (side == "above" or share(f, rule) >= low - room))
        if good:
            want[r.doc_id, r.text, r.lang, r.source] += 1
    out = STAGES["quality rules"](spark, docs, "")
    assert out.columns == docs.columns and rows_of(out) == want and want
    assert STAGES["quality rules"](spark, docs.limit(0), "").count() == 0


def test_near_dedup(spark, docs):
    rows = docs.collect()
    sets, parent = {}, {}
    for k, r in enumerate(rows):
        w = [x.lower() for x in words(r.text)]
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
        parent[k] = k

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(k)] = min(least.get(root(k), r.doc_id), r.doc_id)
    gone = {r.doc_id for k, r in enumerate(rows) if r.doc_id is not None and r.doc_id != least[root(k)]}
    out = STAGES["SimHash near-dedup"](spark, docs, "")
    assert out.columns == docs.columns and gone
    assert rows_of(out) == Counter((r.doc_id, r.text, r.lang, r.source) for r in rows if r.doc_id not in gone)
    assert STAGES["SimHash near-dedup"](spark, docs.limit(0), "").count() == 0


def test_substring_dedup(spark, docs):
    rows = docs.collect()
    first = {}
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        w = words(r.text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), r.doc_id)
    want = Counter()
    for r in rows:
        w = words(r.text)
        cut = set() if r.doc_id is None else {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r.doc_id for j in range(k, k + 13)}
        if not w or len(cut) < len(w):
            want[r.doc_id, tuple(x for j, x in enumerate(w) if j not in cut), r.lang, r.source] += 1
    out = STAGES["substring dedup"](spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and Counter((r.doc_id, tuple(words(r.text)), r.lang, r.source) for r in got) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got) and sum(want.values()) < len(rows) + 1
    assert STAGES["substring dedup"](spark, docs.limit(0), "").count() == 0


def test_mixing(spark, docs):
    """Against the plan's own SQL over the same rows: a row comes as often as the SQL takes it."""
    table = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("given", table)
    plan = Counter((r[0], r[1], r[2], r[4]) for r in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.mix_sql('given')})").fetchall())
    out = STAGES["mixing sources"](spark, docs, "")
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert out.columns == docs.columns
    # Words taken by id; rows of one id and size share them.
    want, have = Counter(), Counter()
    for (doc, _, _, taken), n in plan.items():
        want[doc] += taken * n
    for (doc, text, _), n in got.items():
        have[doc] += len(words(text)) * n
    assert +want == +have and sum(have.values()) > 0
    assert STAGES["mixing sources"](spark, docs.limit(0), "").count() == 0


def test_sentencepiece(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = STAGES["SentencePiece"](spark, docs, "")
    want = Counter((r.doc_id, r.lang, r.source, tuple(sp.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.piece_ids)) for r in out.collect()) == want
    assert out.where("n_pieces <> size(piece_ids)").count() == 0
    assert STAGES["SentencePiece"](spark, docs.limit(0), "").count() == 0


def test_stages_follow_each_other(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = corpus_pipeline.run(spark, sf_dir)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "mixing sources", "SentencePiece"]
    assert 0 < out.count() <= 2 * docs.count() and out.columns == ["doc_id", "lang", "source", "n_pieces", "piece_ids"]
