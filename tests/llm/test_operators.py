"""Each operator on a small fixture with nulls, empty texts, ties, repeats, odd columns, against brute force."""

import hashlib
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from parity import assert_parity

from tidemark.llm import chat, html, mixing, phrases, pieces, quality, simhash, toxicity, warc, webp
from tidemark.llm.jaccard import near_dedup
from tidemark.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, m int, bucket int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", "b"), (4, "", "en", "b"), (5, None, None, None), (None, "no id here", "de", "c"),
        (6, LONG, "en", "a"), (7, "x y z", None, "c"), (7, "x y z", None, "c"), (8, " \t\n ", "fr", None), (9, "ein %%% &&& $$$ " * 30, "de", "c"), (10, "intro words " + base[:200] + " outro", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "k", 2, 3) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(name, spark, sf_dir):
    assert_parity(QUERIES[name], ORACLES[name], spark, sf_dir)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- 1


def test_pieces_equal_the_library(odd, spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ["", " a  b ", "日本語 🙂\n\tx", "q" * 3000, "▁▁ ▁x", " " * 50 + "end  "]
    m = pieces.PieceModel(Path(pieces.MODEL).read_bytes())
    assert [m.encode(t) for t in texts] == [sp.encode(t) for t in texts]
    assert all(m.decode(m.encode(t)) == t for t in texts if "▁" not in t)
    rows = {r.doc_id: r for r in pieces.piece_digests(odd, pieces.read_model(spark, pieces.MODEL)).collect()}
    assert rows[4].n_pieces == rows[5].n_pieces == 0 and rows[6].round_trip


def test_pieces_there_and_back_through_spark(odd, empty, spark):
    model = pieces.read_model(spark, pieces.MODEL)
    clashing = odd.withColumns({"piece_ids": F.lit(1), "decoded": F.lit("x")})
    out = pieces.decode_ids(pieces.encode_texts(clashing, model), model)
    assert out.columns == [*odd.columns, "piece_ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in out.collect()) and out.count() == odd.count()
    kept = pieces.decode_ids(pieces.encode_texts(clashing, model, into="ids"), model, ids="ids", into="back")
    assert kept.columns == [*clashing.columns, "ids", "back"] and kept.where("decoded <> 'x' or piece_ids <> 1").count() == 0
    for none in (pieces.piece_digests(empty, model), pieces.decode_ids(pieces.encode_texts(empty, model), model)):
        assert none.count() == 0


def test_unigram_paths_are_best():
    """A lattice search over all segmentations of short strings."""
    m = pieces.PieceModel(Path(pieces.MODEL).read_bytes())
    m.unigram, m.seen, m.older = True, {}, {}

    def best(text):
        if not text:
            return 0.0
        tails = [m.scores[m.ids[text[:k]]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in m.ids]
        return max(tails, default=m.unknown_score + best(text[1:]))

    for text in ("▁unable", "▁thenreat", "▁ción", "▁über"):
        got = m._chunk(text)
        assert sum(m.scores[i] for i in got) == pytest.approx(best(text))


# ---------------------------------------------------------------- 2


def test_mix(odd, empty):
    rows = mixing.mix_plan(odd).collect()
    total = {}
    for r in rows:
        total.setdefault((r.source_size, r.target), [0, 0])[0] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert len(rows) == odd.count() and mixing.mix_plan(empty).count() == 0
    sizes = sum(len(words(r.text)) for r in odd.collect())
    by_source = {r.source: 0 for r in odd.collect()}
    for r in odd.collect():
        by_source[r.source] += len(words(r.text))
    targets, left, open_ = {}, 1.5 * sizes, dict(zip(sorted(by_source, key=lambda s: (s is None, s)), [5, 2, 1, 5, 2], strict=False))
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * level >= 2 * by_source[s]]
        if not full:
            targets |= {s: w * level for s, w in open_.items()}
            break
        for s in full:
            targets[s] = 2.0 * by_source[s]
            left -= targets[s]
            del open_[s]
    got = {(r.source_size, round(r.target, 6)) for r in rows}
    assert got == {(by_source[s], round(t, 6)) for s, t in targets.items()}
    assert mixing.mix_plan(odd).exceptAll(mixing.mix_plan(odd)).count() == 0
    assert mixing.mix(odd).columns == odd.columns


# ---------------------------------------------------------------- 3


def test_warc(spark, odd, empty):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://x/y").alias("url"), F.col("text").alias("html"), "m", "key")
    good = warc.archives(pages, 5)
    assert warc.audit(good, good).where("corrupt").count() == 0 and good.count() == pages.count()
    record = good.where("key = 3").first().record.decode()
    head, _, body = record.partition("\r\n\r\n")
    assert head.startswith("WARC/1.1\r\n") and f"Content-Length: {len(body.encode()) - 4}" in head
    none = warc.archives(empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html")))
    assert warc.audit(none, none).count() == 0


# ---------------------------------------------------------------- 4


def test_quality_counts(odd, empty):
    def brute(text):
        w = words(text)
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)

    extra = odd.unionByName(odd.where("doc_id = 9").withColumn("text", F.lit("a b c d e f g h i\nq r\nq r\na b c d e f g h z\n" * 2)).withColumn("doc_id", F.lit(11)))
    texts = {(r.doc_id, r.text) for r in extra.collect()}
    got = {(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality.quality_verdicts(extra).collect()}
    assert got == {(i, brute(t)) for i, t in texts}
    assert quality.quality_verdicts(empty).count() == 0
    kept = quality.quality_filter(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {1, 2, 3, 6, 10}


# ---------------------------------------------------------------- 5


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(3)
    plain = [f"term{k}" for k in range(300)]
    rows = []
    for i in range(1600):
        w = rng.choice(plain, 40).tolist()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(0, 40)), str(rng.choice(["idiot", "grobnix" + str(rng.integers(0, 9))])))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "idiot"), (5000, ""), (5001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.train_scorer(docs, labels)).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert np.mean([y == p for y, p in held]) > 0.97 and len(held) > 300
    assert got[5000].score == got[5001].score and 0 <= got[5000].score < 0.3 and not got[None].held_out
    none = toxicity.train_scorer(docs, labels.limit(0))
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def test_grammar_notes_context():
    scorer = toxicity.Scorer({"idiot": (3.0, "insult"), "kill": (2.0, "threat")}, None)
    kinds = lambda text: [scorer.patterns[p][1:] for p, _ in scorer.matches(text)[0]]
    assert kinds("an idiot") == [("insult", False, False, False, False)]
    assert kinds("you idiot") == [("insult", True, False, False, False)]
    assert kinds("he is not an idiot") == [("insult", True, True, False, False)]
    assert kinds("they said: idiot") == [("insult", False, False, False, False)]
    assert kinds("they said an idiot") == [("insult", True, False, True, False)]
    assert kinds("i kill you. you idiot. fine") == [("threat", False, False, False, True), ("insult", True, False, False, False)]
    assert scorer.matches("i kill you. you idiot idiot; fine.. ok")[1] == 4 and [o for _, o in scorer.matches("kill you idiot")[0]] == [5.0]


def naive_clauses(text, lexicon):
    """The clauses read one by one with lists, without transducers."""
    out = []
    for clause in re.split(r"[.;:!?\n]", text.lower()):
        found = re.findall(r"[^\W\d_]+", clause)
        marks = []
        for k, w in enumerate(found):
            if w in lexicon:
                before = found[:k]
                # The scope of a negation ends after SCOPE words.
                negated = any(x in toxicity.NEGATIONS for x in before[-toxicity.SCOPE :])
                marks.append((lexicon[w][1], any(x in toxicity.TARGETS for x in before), negated, any(x in toxicity.REPORTS for x in before), k))
        if marks:
            best = marks[0]
            for m in marks[1:]:
                if toxicity.gravity(m) > toxicity.gravity(best):
                    best = m
            out.append((*best[:4], any(x in toxicity.TARGETS for x in found[best[4] + 1 :])))
    return out


def test_grammar_equals_a_naive_reader():
    rng = np.random.default_rng(11)
    lexicon = {"idiot": (3.0, "insult"), "kill": (2.0, "threat"), "scum": (2.5, "insult")}
    scorer = toxicity.Scorer(lexicon, None)
    pool = ["idiot", "kill", "scum", "you", "he", "not", "never", "said", "word", "other", "plain", "text", ".", "\n", "!"]
    for _ in range(400):
        text = " ".join(rng.choice(pool, int(rng.integers(0, 30))))
        assert [scorer.patterns[p][1:] for p, _ in scorer.matches(text)[0]] == naive_clauses(text, lexicon), text


def test_toxicity_edges(spark, odd, empty):
    """Very long texts, repeated rows, nulls, clashing columns and learned threats."""
    rows = [(i, f"some words {i} here. " + ("i will grubble you now" if i % 4 == 0 else "we zilch tomorrow"), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scorer = toxicity.train_scorer(docs, labels)
    assert scorer.words["grubble"][1] == "threat"
    out = toxicity.score_documents(odd.withColumns({"score": F.lit(1), "toxic": F.lit(1), "predicted": F.lit(2)}), scorer)
    got = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.score, r.predicted))
    assert len(by[7]) == 1 and by[4] == by[5] == by[8] and all(0 <= r.score <= 1 for r in got)
    long = " ".join(["plain text."] * 40_000)
    pair = spark.createDataFrame([(1, long), (2, long + " i will grubble you")], "doc_id long, text string")
    low, high = (r.score for r in toxicity.score_documents(pair, scorer).orderBy("doc_id").collect())
    assert low < high
    assert toxicity.score_documents(empty, scorer).count() == 0


# ---------------------------------------------------------------- 6


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|a", "<\\\\|", "plain\\n", "", None, "<<||"]
    turns = spark.createDataFrame([(1, k, r, t, "x") for k, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "we\nird", None))] + [(None, 0, "assistant", "z", "y"), (2, None, "user", "q", "y")], "conv_id long, turn long, role string, text string, part string")
    out = {}
    for part_chars in (1, 50, 1 << 20):
        out[part_chars] = sorted(map(tuple, chat.conversation_digests(chat.format_conversations(turns, part_chars=part_chars)).collect()), key=str)
    assert out[1] == out[50] == out[1 << 20]
    by = {r[0]: r for r in out[50]}
    want = [(r or "", t or "") for t in nasty for r in ("user", "assistant", "we\nird", None)]
    assert by[1][1:3] == (len(want), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest())
    loss = "".join(t for r, t in want if r == "assistant")
    assert by[1][3:5] == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_conversations(turns.limit(0))).count() == 0
    long = "a very long turn <|im_end|> " * 120_000
    (r,) = chat.conversation_digests(chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string"))).collect()
    assert (r.loss_chars, r.loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest())


def test_template_language():
    from tidemark.llm.template import Sink, TemplateError, compile_template, fold, parse

    def render(source, **values):
        sink = Sink()
        for _ in compile_template(source)(sink, values):
            pass
        return sink.flush()

    assert render("{% for m in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[1, 2, 3])[0] == "1,2,3"
    assert render("{% set a = 1 + 2 %}{{ a ~ '!' }}{{ x | upper }}", x="y")[0] == "3!Y"
    assert render("a{% generation %}b{% endgeneration %}c") == ("abc", [[1, 2]])
    assert fold(parse("{{ 'a' ~ 1 }}{% if 1 == 2 %}x{% else %}y{% endif %}z")) == [("text", "a1yz")]
    for bad in ("{{ x.__class__ }}", "{{ f() }}", "{{ x | open }}", "{% if x %}", "{% import os %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError):
        render("{{ x.real }}", x=1)


# ---------------------------------------------------------------- 7


def test_common_lines():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(0, 12)).tolist(), rng.integers(0, 4, rng.integers(0, 12)).tolist()
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        got = html.common_lines(a, b)
        it = iter(b)
        assert len(got) == table[-1, -1] and all(a[i] in it for i in got)


def test_extraction(spark):
    page = '<html><head><title>T</title></head><body><div class="cookie-notice">We</div><header><h1>S</h1></header><nav>n</nav><article><header><h1>Real &amp; t</h1></header><p>One <b>two</b>\n three<p>four<br>five<aside>x</aside><div class="ad">buy</div><form>f</form><section id="comments">c</section></article><footer>f</footer></body></html>'
    bare = "<body><div>Site name</div><p>{}</p><div>All rights</div></body>"
    rows = [(1, "http://h/a/1", page), (2, "http://g/x/1", bare.format("first story")), (3, "http://g/x/2", bare.format("second story")), (4, None, None), (5, "odd", ""), (5, "odd", ""), (6, "http://solo/z", bare.format("alone")), (7, "http://h/a/2", "<article><p>cut &am")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract_pages(df).collect()}
    assert got == {1: "Real & t One two three four five", 2: "first story", 3: "second story", 4: "", 5: "", 6: "Site name alone All rights", 7: "cut &am"}
    assert html.extract_pages(df).count() == len(rows) and html.extract_pages(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize("transforms", [(), (webp.PREDICTOR,), (webp.CROSS_COLOUR,), (webp.SUBTRACT_GREEN,), (webp.SUBTRACT_GREEN, webp.PREDICTOR, webp.CROSS_COLOUR)])
def test_webp_round_trip(transforms):
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (5, 3), (33, 17)):
        for colours in (1, 3, 15, 200, 1 << 20):
            a = rng.integers(0, 1 << 32, colours, np.uint64).astype(np.uint32)[rng.integers(0, colours, (h, w))]
            for cache in (0, 4, 11):
                for palette in (False, True) if len(np.unique(a)) <= 256 else (False,):
                    assert (webp.decode(webp.encode(a, transforms, cache, palette=palette, tile=2)) == a).all()


def test_webp_many_groups_are_read():
    """A stream with two prefix groups and hand-made codes: pixels left of column 4 use group 0."""
    out = webp._Writer()
    for v, n in ((0x2F, 8), (7, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        out.put(v, n)
    webp._write_image(out, np.array([0xFF000000, 0xFF000100], np.uint32), 2, False)
    for green in (10, 20):
        for symbol in (green, 30, 40, 255, 0):
            for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
                out.put(v, n)
    data = out.bytes()
    data += bytes(len(data) & 1)
    file = b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
    assert webp.decode(file).tolist() == [[0xFF1E0A28] * 4 + [0xFF1E1428] * 4]


def test_webp_file_of_another_encoder():
    """The one-pixel lossless file that browsers' feature tests carry."""
    import base64

    file = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(file).shape == (1, 1) and [x.tolist() for x in webp.decode_all([file] * 20)] == [webp.decode(file).tolist()] * 20


def used_transforms(file):
    return [u[0] for u in webp._Open(file).undo]


def test_webp_transforms_are_chosen_where_they_pay():
    rng = np.random.default_rng(8)
    y, x = np.mgrid[0:64, 0:144]
    noise = rng.integers(0, 3, (64, 144, 4))
    ramp = np.stack([x, y, x + y, np.full_like(x, 255)], axis=2) * (1, 1, 1, 1) + noise * (1, 1, 1, 0)
    steps = webp._pixels((ramp & 255).astype(np.uint8).reshape(-1, 4)).reshape(64, 144)
    green = rng.integers(0, 256, (64, 144))
    linked = np.stack([green // 2 + noise[..., 0], green, green // 2 + noise[..., 1], np.full_like(green, 255)], axis=2)
    tinted = webp._pixels(linked.astype(np.uint8).reshape(-1, 4)).reshape(64, 144)
    text = np.frombuffer(webp.payload_of("plain words of a text without pictures " * 400)[0], "<u4").reshape(-1, 144)
    for pixels, kinds in ((steps, {webp.PREDICTOR}), (tinted, {webp.CROSS_COLOUR})):
        file = webp.encode(pixels)
        assert kinds <= set(used_transforms(file)) and (webp.decode(file) == pixels).all()
        assert len(file) < len(webp.encode(pixels, ()))
    assert (webp.decode(webp.encode(text)) == text).all()


def test_webp_lanes_equal_single_images():
    """Caches, copies and lengths of all sorts, decoded together and one by one."""
    rng = np.random.default_rng(9)
    images = []
    for k in range(40):
        pool = rng.integers(0, 1 << 32, int(rng.integers(2, 60)), np.uint64).astype(np.uint32)
        rows = int(rng.integers(1, 9))
        a = np.concatenate([pool[rng.integers(0, len(pool), rows * 144)], np.full(144 * (k % 3), 0xFFFFFFFF, np.uint32)])
        images.append(a.reshape(-1, 144))
    for bits in (None, 0, 3, 11):
        files = [webp.encode(a, (), bits, palette=False) for a in images]
        assert all((x == a).all() for x, a in zip(webp.decode_all(files), images, strict=True))
        assert all((webp.decode(f) == a).all() for f, a in zip(files, images, strict=True))


def test_webp_images_written_together_equal_single_ones(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ["", "a" * 40_000, "abcd" * 9_000, " ".join(f"x{i}" for i in range(30_000))]
    arrays = [np.frombuffer(webp.payload_of(t)[0], "<u4").reshape(-1, 144) for t in texts]
    files = webp.encode_all(arrays)
    assert files == [webp.encode(a) for a in arrays]
    assert all((x == a).all() for x, a in zip(webp.decode_all(files), arrays, strict=True))
    assert webp.encode_all([]) == [] and webp.encode_all(arrays[:1]) == files[:1]


def test_webp_documents(odd, empty):
    rows = webp.media_features(webp.media_table(odd)).collect()
    want = {(r.doc_id, hashlib.sha256(webp.payload_of(r.text)[0]).hexdigest()) for r in odd.collect()}
    assert {(r.doc_id, r.payload_sha256) for r in rows} == want and len(rows) == odd.count()
    assert all(r.payload_bytes % 576 == 0 and r.payload_bytes >= 576 for r in rows)
    assert webp.media_features(webp.media_table(empty)).count() == 0
    for n in (webp.SIDE, webp.SIDE + 1):
        payload = bytes(range(64)) * 9 * n
        assert webp.load(webp.store(payload))[1] == payload
    with pytest.raises(ValueError):
        webp.decode(webp.store(b"ab" * 288)[:40])


# ---------------------------------------------------------------- 9


def brute_components(fps, ids):
    best = dict(zip(range(len(fps)), ids, strict=True))
    group = list(range(len(fps)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                group[root(a)] = root(b)
    return [min((best[j] for j in best if root(j) == root(k) and best[j] is not None), default=None) for k in range(len(fps))]


def test_simhash(odd, empty):
    rows = simhash.near_classes(odd).collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    assert [r.component_id for r in rows] == brute_components(fps, [r.doc_id for r in rows])
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(simhash.fingerprint(texts[r.doc_id]) == int(r.fingerprint, 16) for r in rows)
    assert simhash.near_classes(empty).count() == 0
    kept = near_dedup(odd)
    assert kept.columns == odd.columns and 2 not in {r.doc_id for r in kept.collect()}


def test_links_in_chunks(spark):
    """A hot shard is cut into chunks and loses no link; chains join across chunks."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    fps = [centre]
    for _ in range(250):
        f = fps[int(rng.integers(0, len(fps)))]
        for bit in rng.choice(20, int(rng.integers(1, 6)), replace=False):
            f ^= 1 << int(bit)
        fps.append(f)
    fps += [int(x) for x in rng.integers(0, 1 << 62, 50)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components(fps, fps)
    for chunk in (16, 4096):
        links = simhash.fingerprint_links(df, len(fps), chunk=chunk)
        from tidemark.llm.components import components

        root = {r.node: r.root for r in components(links, "a", "b").collect()}
        assert [root.get(f, f) for f in fps] == want


@pytest.mark.parametrize("m", [4, 5, 6])
def test_shards_hold_every_link(spark, m):
    rng = np.random.default_rng(m)
    pairs = [(x, x ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False))) for x in rng.integers(0, 1 << 62, 200).tolist()]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(F.arrays_overlap(simhash.shard_keys(F.col("a"), m), simhash.shard_keys(F.col("b"), m))).count() == len(pairs)


# ---------------------------------------------------------------- 10


def test_phrases(odd, empty):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None), key=lambda x: x[0])
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    got = phrases.phrase_removals(odd).collect()
    assert sorted((tuple(r) for r in got if r.doc_id is not None), key=str) == sorted(want, key=str) and len(got) == odd.count()
    assert phrases.phrase_removals(empty).count() == 0
    clashing = odd.withColumns({"passages": F.lit(1), "emptied": F.lit("x"), "_gone": F.lit(2), "_passages": F.lit(3), "passage_doc": F.lit(4)})
    assert phrases.phrase_dedup(clashing).columns == clashing.columns
    cut = {r.doc_id: r for r in phrases.phrase_dedup(clashing).collect()}
    assert 2 not in cut and cut[3].text == "tail" and cut[3].n_chars == 4 and cut[6].text == LONG


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    raw = (" alpha beta\tgamma\n" * 50 + "x" * 500 + " é ü end").encode()
    whole = phrases.word_hashes(raw)
    monkeypatch.setattr(phrases, "_BLOCK_BYTES", 37)
    cut = phrases.word_hashes(raw)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert [raw[a:b] for a, b in zip(whole[1], whole[2], strict=True)] == raw.split()


def test_cut_text():
    assert phrases.cut_text(" a b\n c  d", b"a b c d".split(), bytearray([0, 1, 1, 0])) == " a d"
