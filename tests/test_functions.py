"""Hand-computed values of the expressions."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import scoring as S
from tidemark.functions import similarity as C
from tidemark.functions import text as T
from tidemark.functions.metaphone import metaphone
from tidemark.functions.records import goods_terms, int_list, parsed, source_id
from tidemark.operators.bulletin import HEADINGS, NUMBER, SPACED_NUMBER, bulletin_events
from tidemark.operators.merge import merge, merge_in_order, snapshot_diff, versions
from tidemark.sources.documents import pages_of
from tidemark.sources.registry import detail, fixture_search, page_size, poll, read_pages, search_expression


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(("a", "b", "least", "most"), [("Nike", "nike", 100, 100), ("Nike", "Nikee", 80, 100), ("Apple", "Apple Inc", 50, 100), ("", "x", 0, 0), ("lewenstein", "levenshtein", 85.714, 85.715)])
def test_text_similarity(spark, a, b, least, most):
    assert least <= one(spark, C.text_similarity(F.lit(a), F.lit(b)))[0] <= most


def test_trigrams(spark):
    assert one(spark, F.round(C.jaccard(T.trigrams(F.lit("word")), T.trigrams(F.lit("two words"))), 4))[0] == 0.3636


@pytest.mark.parametrize(("text", "code"), [("ção", "cao"), ("filho", "filo"), ("banho", "bano"), ("caça", "caca"), ("passo", "paso"), ("áéíóú", "aeiou"), ("Maria", "maria"), ("cena", "sna"), ("guerra", "gra")])
def test_pt_phonetic_code(spark, text, code):
    assert one(spark, T.pt_phonetic_code(F.lit(text)))[0] == code


def test_metaphone():
    assert metaphone("Smith") == metaphone("Smyth") == "SM0"
    assert metaphone("Nike") != metaphone("Adidas")
    assert (metaphone("Knight"), metaphone("Phone"), metaphone("Xavier"), metaphone("")) == ("NT", "FN", "SFR", "")


def test_scores(spark):
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    assert one(spark, F.round(C.class_overlap(ints(1, 2), ints(2, 3)), 2), C.class_overlap(ints(), ints(1))) == (33.33, 0.0)
    f = lambda x: F.lit(float(x))
    assert one(spark, C.composite_score(f(80), f(60), f(40)), F.round(C.composite_score(f(90), f(50), f(70), (0.7, 0.2, 0.1)), 6), C.composite_score(f(9), f(1), f(1), (0, 0, 0))) == (66.0, 80.0, 9.0)
    assert one(spark, C.similarity_band(f(92)), C.similarity_band(f(74)), C.similarity_band(f(10))) == ("high", "medium", "low")


def test_lifecycle(spark):
    r = D.next_renewal(day("2015-03-15"), F.lit(2024))
    assert one(spark, r, D.grace_end(r)) == (dt.date(2025, 3, 15), dt.date(2025, 9, 11))
    assert one(spark, D.opposition_due(day("2024-01-15"), F.lit("pt")), D.opposition_due(day("2024-01-15"), F.lit("euipo")), D.refusal_due(day("2024-06-01")), D.refusal_due(day("2024-06-01"), 30)) == (
        dt.date(2024, 3, 15), dt.date(2024, 4, 14), dt.date(2024, 7, 31), dt.date(2024, 7, 1),
    )
    assert one(spark, D.next_renewal(day("2020-02-29"), F.lit(2025)))[0] == dt.date(2030, 2, 28)
    assert one(spark, D.alert_schedule(day("2024-03-01"), day("2024-02-01")))[0] == [dt.date(2024, 2, 23), dt.date(2024, 2, 29)]
    assert one(spark, D.iso_date(F.lit("2024-01-15T10:00:00Z")), D.iso_date(F.lit("not-a-date"))) == (dt.date(2024, 1, 15), None)


@pytest.mark.parametrize(("state", "event", "after"), [*[(s, e, t) for (s, e), t in D.TRANSITIONS.items()], (" Active ", "unknown", "active"), (None, "x", "")])
def test_transitions(spark, state, event, after):
    assert one(spark, D.next_status(F.lit(state).cast("string"), F.lit(event)))[0] == after


def test_confidence(spark):
    full = S.record_confidence(F.lit("018765432"), F.lit("ACME TECH"), F.lit("Registered"), F.lit("2024-01-15"), F.array(F.lit("9"), F.lit("42")), F.lit("EUIPO"))
    assert one(spark, full["overall"], full["issues"], full["needs_review"]) == (1.0, [], False)
    got = one(spark, S.number_score(F.lit("???"), F.lit("PT")), S.word_mark_score(F.lit("A")), S.word_mark_score(F.lit("###@@@!!")), S.status_score(F.lit("SOMETHING_ODD")), S.date_score(F.lit("not-a-date")), S.classes_score(F.array(F.lit("9"), F.lit("99"))), S.classes_score(F.array(F.lit("garbage"))))
    assert got == (0.5, 0.4, 0.5, 0.7, 0.3, 0.5, 0.2)


def test_assessment(spark):
    level = lambda m, d="": S.distinctiveness(F.lit(m), F.lit(d))["level"]
    assert one(spark, level("Zyphora"), S.distinctiveness(F.lit("Online Shop"), F.lit(""))["score"] < 70, level("")) == ("fully_met", True, "not_met")
    numbers = lambda d, *given: F.transform(S.recommended_classes(F.lit(d), F.array(*[F.lit(g) for g in given]).cast("array<int>")), lambda c: c["class_number"])
    got = one(spark, numbers("plataforma SaaS"), numbers("Loja de e-commerce"), numbers("serviços jurídicos"), numbers("nada", 12), numbers("nada"))
    assert 42 in got[0] and 35 in got[1] and 45 in got[2] and got[3] == [12] and got[4] == [35]
    risk = S.opposition_risk(F.lit("fully_met"), F.lit(92.0), F.lit(False))
    assert one(spark, risk, S.verdict(F.lit("fully_met"), risk, F.lit(False)), S.verdict(F.lit("fully_met"), F.lit("low"), F.lit(True)), S.verdict(F.lit("fully_met"), F.lit("low"), F.lit(False))) == ("high", "not_recommended", "not_recommended", "eligible")


def page_events(spark, page, number=NUMBER):
    docs = spark.createDataFrame([(1, [page + "\n" + "." * 60])], "doc_id int, pages array<string>").withColumn("bulletin_date", F.lit("2024-01-02").cast("date"))
    return sorted((r.event_type, r.application_number) for r in bulletin_events(docs, number).collect())


def test_bulletin(spark):
    assert page_events(spark, "Despacho de Publicação n. 12345\nNº de pedido: N.987654\nMarca: SUPERMARK") == [("publication", "N.987654")]
    assert page_events(spark, "Publicação\nsem número") == []
    assert page_events(spark, "Concessão\nProcesso: 770 255", SPACED_NUMBER) == [("grant", "770255"), ("transfer", "770255")]
    assert page_events(spark, "RENOVAÇÃO\nProcesso: 1\n" + "\n" * 9 + "Cessão\nProcesso: 2") == [("renewal", "1"), ("transfer", "2")]
    assert page_events(spark, "Recusa e Caducidade\nProcesso:\nProcesso: 1") == [("lapse", ":"), ("provisional_refusal", ":")]  # the colon alone is a number, as the pattern has it
    assert page_events(spark, " \n ") == []


def test_bulletin_numbers_of_the_next_lines(spark):
    """Random lines against a plain search of each line and the seven after it."""
    rng = random.Random(6)
    parts = ["Concessão", "RECUSA", "Processo:", "Processo: 12", "Nº de pedido N-3", "texto", "", "Processo\x00 9", "Application No: \x00", "Cessão Processo 7"]
    pages = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) + "\n" + "." * 60 for _ in range(60)]
    docs = spark.createDataFrame([(k, [p]) for k, p in enumerate(pages)], "doc_id int, pages array<string>").withColumn("bulletin_date", F.lit("2024-01-02").cast("date"))
    got = sorted((r.doc_id, r.event_type, r.application_number, r.raw_text) for r in bulletin_events(docs).collect())
    want = []
    for k, page in enumerate(pages):
        rows = page.split("\n")
        for n, row in enumerate(rows):
            hits = [m[1] for x in rows[n : n + 8] if (m := re.search(r"(?i)(?:N[º°]\s*de\s*pedido|N[º°]\.?\s*Pedido|Application\s*No|Processo)[\s:]*(\S+)", x.replace("\0", " ")))]
            want += [(k, kind, hits[0], row) for kind, pattern in HEADINGS.items() if hits and re.search(f"(?i)(?:{pattern})", row)]
    assert got == sorted(want) and len(want) > 100


def test_records(spark):
    raw = parsed(F.lit('{"classes": [9, 42], "one": 7}'))
    assert one(spark, int_list(raw, "classes"), int_list(raw, "one"), int_list(raw, "none")) == ([9, 42], [7], [])
    pairs = goods_terms(F.array(F.lit(9), F.lit(42)), F.lit("Software; IT services"))
    assert [tuple(p) for p in one(spark, pairs)[0]] == [(9, "Software"), (42, "IT services")]
    assert one(spark, source_id(F.lit(None), F.lit(None), F.lit("018")))[0] == "EUIPO-018"


def test_diff(spark):
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    d = one(spark, snapshot_diff(m(status="Published", word_mark="X", renewal_status="Old"), m(status="Registered", word_mark="X", registration_number="123")))[0]
    assert (d.added, d.removed, d.changed) == ({"registration_number": "123"}, {"renewal_status": "Old"}, {"status": "Published -> Registered"})


def test_merge_is_idempotent(spark):
    batch = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, f string, g string")
    first = merge(batch.limit(0), batch, "id", ["f", "g"])
    assert {r.outcome for r in first.collect()} == {"created"}
    again = merge(first.select("id", "f", "g"), batch, "id", ["f", "g"])
    assert {r.outcome for r in again.collect()} == {"unchanged"}
    new = spark.createDataFrame([(1, "", "y"), (None, "q", "q")], "id int, f string, g string")
    got = {r.id: (r.f, r.g, r.outcome) for r in merge(batch, new, "id", ["f", "g"]).collect()}
    assert got == {1: ("a", "y", "updated"), 2: ("b", None, "kept"), None: ("q", "q", "skipped")}
    old = spark.createDataFrame([(1, 3)], "id int, version_number int")
    assert sorted(r.version_number for r in versions(batch, "id", ["f"], old).collect()) == [1, 4]


def test_sources(spark, tmp_path):
    def write(folder, *pages):
        (tmp_path / folder).mkdir()
        for k, body in enumerate(pages):
            (tmp_path / folder / f"p{k}.json").write_text(body)
        return read_pages(spark, str(tmp_path / folder))

    full = '{"trademarks": [%s]}' % ", ".join('{"n": %d}' % k for k in range(10))
    ends = lambda pages, **kw: poll(pages, 10, **kw)[1]
    short = write("short", full, full.replace("trademarks", "results"), '[{"n": 5}]', full)
    assert ends(short) == {"pages": 3, "complete": True, "next_page": None} and poll(short, 10)[0].count() == 21
    assert ends(short, max_pages=2) == {"pages": 2, "complete": False, "next_page": 2}
    total = write("total", full[:-1] + ', "totalPages": 1}', full)
    assert ends(total) == {"pages": 1, "complete": True, "next_page": None}
    assert ends(write("empty", "{}")) == {"pages": 1, "complete": True, "next_page": None} and ends(short.limit(0)) == {"pages": 0, "complete": True, "next_page": None}
    for bad in (write("large", full.replace("[", '[{"n": 99}, ')), write("none", "3"), write("broken", "{")):
        with pytest.raises(ValueError):
            poll(bad, 10)
    assert (page_size(1), page_size(500)) == (10, 100)
    found = detail(poll(short, 10)[0], spark.createDataFrame([("5",), ("77",)], "key string"), "n").collect()
    assert {r.key for r in found} == {"5"} and len(found) == 3
    assert search_expression("ab", "PT", [1, 2], "2024") == "wordMark==*ab*;jurisdiction==PT;niceClass=in=(1,2);updateDate=ge=2024"
    marks = spark.createDataFrame([("ACME TECH", "1"), ("SOLARIS", "2")], "word_mark string, application_number string")
    assert fixture_search(marks, "acme").count() == 1 and fixture_search(marks, "zzz").count() == 2
    assert pages_of("a\fb".encode()) == (["a", "b"], None) and pages_of(b"") == ([], "empty")


def test_merge_in_order(spark):
    """The same key twice in a batch gives two versions, in order, against a plain loop."""
    rng = random.Random(4)
    pick = lambda: rng.choice([None, "", "a", "b", "c"])
    current = [(k, pick() or None, pick() or None) for k in range(4)]
    batch = [(rng.choice([0, 1, 2, 3, 4, 5, None]), n, pick(), pick()) for n in range(60)]
    got = {r.n: (r.f, r.g, r.outcome, r.version) for r in merge_in_order(spark.createDataFrame(current, "id int, f string, g string"), spark.createDataFrame(batch, "id int, n int, f string, g string"), "id", ["f", "g"], ["n"]).collect()}
    state, count = {k: [f, g] for k, f, g in current}, {}
    for k, n, *new in batch:
        if k is None:
            assert got[n][:3] == (*new, "skipped")
            continue
        old = state.get(k)
        state[k] = [x or y for x, y in zip(new, old or [None, None], strict=True)]
        outcome = "created" if old is None else "updated" if old != state[k] else "unchanged"
        count[k] = count.get(k, 0) + (outcome != "unchanged")
        assert got[n] == (*state[k], outcome, count[k])
