"""Pages and bookmarks of PDF files."""

import json

import duckdb
import pytest

import __spark_entry__
from tessera.plans.files import pdf_of
from tessera.sources import extract, pdf

PAGES = [["Erste Zeile", "", "  zwei   Worte ", "漢字 😀"], [], ["last (page) \\ é"]]
MARKS = [("Top", 1), ("Below – 2", 2), ("", 3), ("Üben", 3)]


def test_pages_and_bookmarks():
    for packed in (False, True):
        doc = pdf.opened(pdf_of(PAGES, MARKS, packed))
        assert [doc.lines(p) for p in doc.pages()] == [["Erste Zeile", "zwei Worte", "漢字 😀"], [], ["last (page) \\ é"]]
        assert doc.bookmarks() == [{"title": "Top", "page": 1, "items": [{"title": t, "page": p, "items": []} for t, p in MARKS[1:]]}]


def test_hand_made_file():
    data = rb"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 8 0 R /Names << /Dests << /Names [(here) [7 0 R /Fit]] >> >> >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 6 0 R 2 0 R] >> endobj % the tree refers to itself
3 0 obj << /Type /Page /Contents [4 0 R 5 0 R] >> endobj
4 0 obj << /Length 60 >> stream
BT /F0 9 Tf (Nested \(one\) (two)) Tj [(A) -20 (B) -500 (C\101\
D)] TJ ET
endstream endobj
5 0 obj << /Filter /DCTDecode >> stream
junk endstream endobj
6 0 obj << /Type /Pages /Kids [7 0 R] >> endobj
7 0 obj << /Type /Page /Contents 10 0 R >> endobj
10 0 obj << >> stream
BT 1 0 0 1 0 0 Tm <48 69> Tj 0 -12 Td (caf\351) ' 5 0 Td ( same line) Tj ET
endstream endobj
8 0 obj << /First 9 0 R >> endobj
9 0 obj << /Title (Caf\351) /A << /S /GoTo /D (here) >> /Next 9 0 R >> endobj
trailer << /Root 1 0 R >>"""
    doc = pdf.opened(data)
    assert [doc.lines(p) for p in doc.pages()] == [["Nested (one) (two)AB CAD"], ["Hi", "café same line"]]
    assert doc.bookmarks() == [{"title": "Café", "page": 2, "items": []}]


def test_what_cannot_be_read_is_none_or_empty():
    assert pdf.opened(b"") is None and pdf.opened(b"%PDF-1.4 (text) Tj") is None
    assert pdf.opened(pdf_of([["x"]], []).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")) is None
    cut = pdf_of([["x"], ["y"]], MARKS[:1])
    for n in range(0, len(cut), 37):
        doc = pdf.opened(cut[:n])
        assert doc is None or [pdf.lines_of(doc, p) for p in doc.pages()] is not None
    assert extract.pdf_text(b"%PDF-1.4 (Hello there) Tj")[:2] == ("Hello there", None)


def test_rows_of_pages(spark):
    rows = [("a", pdf_of([[f"page {k}"] for k in range(25)], [])), ("b", pdf_of(PAGES, MARKS)), ("c", b"no pdf"), ("d", None), ("a", pdf_of([["other"]], []))]
    got = pdf.page_rows(spark.createDataFrame(rows, "doc_id string, content binary"), at_a_time=10)
    found = sorted((r.doc_id, r.page, r.lines) for r in got.collect())
    assert found == sorted([("a", k + 1, [f"page {k}"]) for k in range(25)] + [("a", 1, ["other"]), ("b", 1, ["Erste Zeile", "zwei Worte", "漢字 😀"]), ("b", 2, []), ("b", 3, ["last (page) \\ é"])])
    whole = extract.extract(spark.createDataFrame([("b", "b.pdf", "", rows[1][1])], "doc_id string, name string, mime string, content binary")).first()
    assert whole.pages == ["Erste Zeile\nzwei Worte\n漢字 😀", "", "last (page) \\ é"] and json.loads(whole.bookmarks)[0]["title"] == "Top"


def test_all_pages_of_a_long_file():
    data = pdf_of([[f"page {k}"] for k in range(3005)], [])
    doc = pdf.opened(data)
    assert [doc.lines(p) for p in doc.pages()] == [[f"page {k}"] for k in range(3005)]
    assert extract.pdf_text(data)[2] is None and "3006" in extract.pdf_text(data.replace(b"/Count 3005", b"/Count 3006"))[2]


def test_bookmarks_of_long_textless_and_deep_files(spark):
    n = 6100
    marks = [("Top", 1), *[(f"m{k}", k) for k in range(2, n + 1)]]
    doc = pdf.opened(pdf_of([["x"]] * n, marks))
    assert [(x["title"], x["page"]) for x in doc.bookmarks()[0]["items"]] == marks[1:]
    blank = pdf_of([[" "], []], MARKS[:2])
    deep = b"%PDF-1.4\n1 0 obj << /Pages 2 0 R /Outlines 3 0 R /Names << /Dests << /Kids [4 0 R 4 0 R] >> >> >> endobj 2 0 obj << /Kids [5 0 R 6 0 R] >> endobj 3 0 obj << /First 10 0 R >> endobj 4 0 obj << /Names [(a) [6 0 R]] /Kids [4 0 R] >> endobj 5 0 obj << >> endobj 6 0 obj << >> endobj "
    deep += b"".join(b"%d 0 obj << /Title (t%d) /Dest (a) /First %d 0 R >> endobj " % (k, k, k + 1) for k in range(10, 1500)) + b"trailer << /Root 1 0 R >>"
    files = spark.createDataFrame([("blank", "a.pdf", "", blank), ("deep", "b.pdf", "", deep)], "doc_id string, name string, mime string, content binary")
    got = {r.doc_id: r.outline for r in extract.flatten_bookmarks(extract.extract(files).filter("bookmarks is not null")).collect()}
    assert [(e.title, e.page, e.level) for e in got["blank"]] == [("Top", 1, 1), ("Below – 2", 2, 2)]
    assert [(e.title, e.page) for e in got["deep"]] == [(f"t{k}", 2) for k in range(10, 1500)] and len(got["deep"][-1].path) == 1489


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """An input folder of documents without text or id, and of a long one."""
    path = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", " ", "\n" * 50, " \t\n\u3000", "plain text", "two\nlines", "\n".join(f"line {k}" for k in range(450))]
    texts += ["a\x00b", "\ufeffstart \ufeff", "x\u0085\x1cy\x1d", "\u00a0 l1\r\nl2\rl3\u2028", "\U0001f600 \ud7ff\ue000\uffff", "(paren) \\ % <41> /N 5 0 obj endstream"]
    rows = [*enumerate(texts), (None, "no id"), (5, "id of another")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_bookmarks_of_odd_documents_are_as_in_sql(spark, odd):
    assert_as_in_sql(spark, odd, "pdf_bookmarks")


def test_pages_of_odd_documents_are_as_in_sql(spark, odd):
    assert_as_in_sql(spark, odd, "pdf_pages")


def assert_as_in_sql(spark, path, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    result = db.execute(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, path).select(*[d[0] for d in result.description]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(result.fetchall(), key=repr)


def test_files_are_opened_once_and_long_ones_are_read_in_parts(spark):
    rows = [(1, pdf_of([[f"page {k}", "漢字"] for k in range(2000)], [])), (2, pdf_of(PAGES, MARKS, True)), (3, b"no pdf"), (None, None)]
    files = spark.createDataFrame(rows, "doc_id long, content binary")
    pages = {1: [[f"page {k}", "漢字"] for k in range(2000)], 2: [["Erste Zeile", "zwei Worte", "漢字 😀"], [], ["last (page) \\ é"]]}
    want = sorted((i, k + 1, lines) for i, found in pages.items() for k, lines in enumerate(found))
    for at_a_time, long in ((3, pdf.LONG_FILE), (3, 0), (700, 20_000)):
        got = pdf.page_rows(files, at_a_time, long)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 2 and "content" not in plan[: plan.rindex("MapInArrow")]
        assert sorted((r.doc_id, r.page, r.lines) for r in got.collect()) == want


def test_maps_of_fonts():
    def shown(ranges, codes):
        body = b"1 begincodespacerange <0000> <FFFF> endcodespacerange %s endbfrange" % ranges
        return pdf._lines(([(b"/F 1 Tf %s Tj" % codes, 0)], {"F": (body, 0)}), {})

    assert shown(b"<0041> <0043> <0061>", b"<0042>") == ["b"] and shown(b"<0041> <0043> <0061>", b"<0044>") == []
    assert shown(b"<0000> <7FFF> <0000> <8000> <FFFF> <8000>", b"<00E9D83DDE00D800>") == ["é😀\ufffd"] == shown(b"<0000> <FFFE> <0000>", b"<00E9D83DDE00D800>")
    assert shown(b"<0000> <FFFF> <FFFF>", b"<0001>") == []  # past the last unit: no text, and no error
