"""Page text of generated PDF files equals the texts they were made from; damaged files give a reason."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.plans.bulletin import pdf_of
from tidemark.sources.documents import pages_of, read_documents
from tidemark.sources.pdf import File, Reader, page_text

PAGES = [["Boletim da PI", "Nº de pedido: N-123456", "ação (não) \\ fim"], ["日本 €", "𝒳 tail"], []]


def texts(pages):
    return ["\n".join(p) for p in pages]


def test_generated_files():
    assert pages_of(pdf_of(PAGES)) == (texts(PAGES), None)
    assert pages_of(b"\n" + pdf_of(PAGES[:1])) == (texts(PAGES[:1]), None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["C", "Z"]), min_size=1, max_size=30), max_size=6), min_size=1, max_size=4))
def test_any_text_comes_back(pages):
    assert pages_of(pdf_of(pages)) == (texts(pages), None)


def obj(n, body, stream=None):
    packed = b"" if stream is None else b"\nstream\n" + stream + b"\nendstream"
    return b"%d 0 obj\n%s%s\nendobj\n" % (n, body, packed)


def simple(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", more=b"", head=b"%PDF-1.4\n"):
    catalogue = obj(1, b"<< /Type /Catalog /Pages 2 0 R >>") + obj(2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> >> >>")
    return head + catalogue + obj(3, b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>") + obj(4, b"<< /Length %d >>" % len(content), content) + obj(5, font) + more + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("content, text", [
    (b"BT /F1 12 Tf 72 700 Td (Hello \\(you\\)) Tj 0 -14 Td [(Wor) -20 (ld) -500 (again)] TJ ET", "Hello (you)\nWorld again"),
    (b"BT /F1 9 Tf 1 0 0 1 50 700 Tm (a\\341b) Tj 1 0 0 1 90 700 Tm <63> Tj 1 0 0 1 50 680 Tm (d) Tj T* (e) Tj (f) ' ET", "aáb" + "c\nd\ne\nf"),
    (b"q BI /W 1 ID (\x00) Tj EI Q BT /F1 9 Tf (after) Tj 30 0 Td (it) Tj ET % (comment) Tj\n", "after it"),
    (b"BT /F1 9 Tf (line\\\nbreak \\101\\7) Tj ET /X Do", "linebreak A\x07\nfrom the form"),
])
def test_operators(content, text):
    form = obj(6, b"<< /Subtype /Form /Length 40 >>", b"BT /F1 9 Tf (from the form) Tj ET")
    assert pages_of(simple(content, more=form)) == ([text], None)


def test_fonts():
    body = b"BT /F1 9 Tf (\\001\\002\\003AB) Tj ET"
    assert pages_of(simple(body, b"<< /Subtype /Type1 /Encoding << /Differences [1 /eacute /uni20AC /ccedilla 65 /x] >> >>"))[0] == ["é€çxB"]
    cmap = zlib.compress(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <D835DCB3>] endbfrange")
    font = b"<< /Subtype /Type0 /ToUnicode 7 0 R >>"
    more = obj(7, b"<< /Filter /FlateDecode /Length %d >>" % len(cmap), cmap)
    assert pages_of(simple(b"BT /F1 9 Tf <0001001000120021FFFF> Tj ET", font, more))[0] == ["fiac𝒳"]
    assert pages_of(simple(b"BT /F1 9 Tf <0001> Tj ET", font)) == ([], "PDF: a font without a Unicode map")


def test_object_streams_updates_and_wrong_lengths():
    inner = b"1 0 2 33 3 90 << /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 5 0 R >> >> >> << /Type /Page /Contents [4 0 R 9 0 R] >>"
    first = inner.index(b"<<")
    offsets = [0, inner.index(b"<< /Type /Pages") - first, inner.index(b"<< /Type /Page /") - first]
    head = b" ".join(b"%d %d" % (n + 1, o) for n, o in enumerate(offsets)) + b" "
    packed = zlib.compress(head + inner[first:])
    file = b"%PDF-1.5\n" + obj(8, b"<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length 10 0 R >>" % len(head), packed) + obj(10, b"%d" % len(packed))
    file += obj(4, b"<< /Length 9999 >>", b"BT /F1 9 Tf (old) Tj ET") + obj(5, b"<< /Subtype /Type1 >>") + obj(9, b"<< >>", b"BT /F1 9 Tf (two) Tj ET") + obj(4, b"<< /Length 1 >>", b"BT /F1 9 Tf (new) Tj ET")
    assert pages_of(file + obj(11, b"<< /Type /XRef /Root 1 0 R >>", b"x"))[0] == ["new\ntwo"]


@pytest.mark.parametrize("data, why", [
    (b"%PDF-1.7 garbage", "no catalogue"), (pdf_of(PAGES).replace(b"/Root", b"/Encrypt 3 0 R /Root"), "encrypted"), (simple(b"x").replace(b"<< /Length 1 >>", b"<< /Length 1 /Filter /LZWDecode >>"), "filter LZWDecode"),
    (simple(b"x").replace(b"<< /Length 1 >>", b"<< /Length 1 /Filter /FlateDecode >>"), "a stream is damaged"), (simple(b"x").replace(b"/Kids [3 0 R]", b"/Kids []"), "no page"), (b"%PDF-1.4\n1 0 obj " + b"[" * 5000, "too deep"),
])
def test_damaged_files_give_a_reason(data, why):
    assert pages_of(data) == ([], f"PDF: {why}")


def test_cut_and_changed_files_never_crash():
    whole = pdf_of(PAGES)
    for k in range(0, len(whole), 7):
        for data in (whole[:k], whole[:k] + b"\x00>>]" + whole[k + 3 :]):
            pages, why = pages_of(data)
            assert pages or why


def test_pages_that_point_in_circles():
    loop = simple(b"BT /F1 9 Tf (once) Tj ET").replace(b"/Kids [3 0 R]", b"/Kids [3 0 R 2 0 R 3 0 R]")
    assert pages_of(loop) == (["once"], None)
    assert Reader(b"<< /A 1 0 R /B [2 0 R] >>").next() == {"A": (1, 0), "B": [(2, 0)]}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_of(PAGES))
    (tmp_path / "b.txt").write_bytes("um\fdois".encode())
    (tmp_path / "c.bin").write_bytes(b"")
    (tmp_path / "d.pdf").write_bytes(pdf_of(PAGES)[:200])
    got = {r.path.rsplit("/", 1)[1]: (r.pages, r.reason) for r in read_documents(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] == (texts(PAGES), None) and got["b.txt"] == (["um", "dois"], None) and "c.bin" not in got
    assert got["d.pdf"][0] == [] and got["d.pdf"][1].startswith("PDF: ")


def test_a_font_is_read_once_and_a_wide_range_by_the_codes_asked_for():
    file = File(pdf_of([["one"], ["two"]]))
    assert [page_text(file, page, resources) for page, resources in file.pages()] == ["one", "two"]
    assert len(file.fonts) == 1 and set(next(iter(file.fonts.values())).map) == {ord(c) for c in "onetw"}


def test_later_entries_of_a_unicode_map_replace_wide_ranges():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0041> <0078> endbfchar 1 beginbfrange <0000> <FFFF> <0000> endbfrange 1 beginbfchar <0042> <0079> endbfchar"
    more = obj(7, b"<< /Length %d >>" % len(cmap), cmap)
    assert pages_of(simple(b"BT /F1 9 Tf <004100420043> Tj ET", b"<< /Subtype /Type0 /ToUnicode 7 0 R >>", more))[0] == ["AyC"]
