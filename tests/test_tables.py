"""Folders, enrichment, extraction, streams, exports, the facade, and every query against its SQL."""

import collections
import io
import json
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera import schema as S
from tessera.api import KnowledgeBase, bounded_int, flag, string_list
from tessera.operators import chunking, enrich, export, folders, listing
from tessera.plans import catalogue
from tessera.sources import extract, sinks
from tessera.operators import store
from tessera.streaming import ingest, lifecycle, runs
from tests.test_engine import chunk_rows, doc_rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("a", "Alpha", None, 1), ("b", "beta", "a", 2), ("c", "c", "b", 3), ("d", "d", "c", 4), ("e", "e", "d", 5), ("z", "Zed", "gone", 6)]
    df = spark.createDataFrame([(f, n, p, None, o) for f, n, p, o in rows], S.FOLDERS)
    docs = spark.createDataFrame([("1", "c"), ("2", "e"), ("3", None), ("4", "a")], "doc_id string, folder_id string")
    return df, docs


def test_folder_queries(spark, tree):
    df, docs = tree
    got = {r.folder_id: (r.path, r.depth) for r in folders.paths(df).collect()}
    assert got["c"] == ("Alpha / beta / c", 3) and got["z"] == ("Zed", 1)
    assert {r.folder_id for r in folders.subtree(df, "c").collect()} == {"c", "d", "e"}
    assert {r.folder_id: r.height for r in folders.heights(df).collect()}["a"] == 5
    assert {r.doc_id for r in folders.subtree_docs(df, docs, "b").collect()} == {"1", "2"}
    assert {r.doc_id for r in folders.subtree_docs(df, docs, None).collect()} == {"3"}
    assert [r.folder_id for r in folders.display_order(df).orderBy("place").collect()] == ["a", "b", "c", "d", "e", "z"]
    cycle = spark.createDataFrame([("x", "x", "y", None, 1), ("y", "y", "x", None, 2)], S.FOLDERS)
    assert folders.paths(cycle).count() == 2


def test_folder_changes(spark, tree):
    df, docs = tree
    made = folders.create(df, "n", " New / one ", "d")
    assert made.filter("folder_id = 'n'").first().name == "New  one"
    for bad in (("n", "deep", "e"), ("n", "x", "nowhere"), ("n", "  ", None), ("n", "ALPHA", None)):
        with pytest.raises(folders.FolderError):
            folders.create(df, *bad)
    assert folders.rename(df, "b", "Beta").filter("folder_id = 'b'").first().name == "Beta"
    with pytest.raises(folders.FolderError):
        folders.move(df, "a", "c")
    with pytest.raises(folders.FolderError):
        folders.move(df, "a", "z")
    assert folders.move(df, "d", "z").filter("folder_id = 'd'").first().parent_id == "z"
    left, hoisted = folders.delete(df, docs, "c")
    assert {r.folder_id for r in left.collect()} == {"a", "b", "z"}
    assert {r.doc_id: r.folder_id for r in hoisted.collect()} == {"1": "b", "2": "b", "3": None, "4": "a"}


def test_enrichment(spark):
    rows = [("d", k, f"T{k}", f"Sentence number {k} is here. More text.", {"heading": k % 3 == 0, "entities": ["A"]}) for k in range(9)]
    chunks = chunk_rows(spark, rows)
    assert sorted(r.chunk_index for r in enrich.select_targets(chunks, 4).collect()) == [0, 1, 3, 6]
    assert enrich.select_targets(chunks, 0).count() == enrich.select_targets(chunks, 99).count() == 9
    done = enrich.enrich(chunks, enrich.FirstSentence(), 4)
    assert done.filter("summary is not null").count() == 4 and done.columns == chunks.columns
    cover = enrich.coverage(done).first()
    assert (cover.chunks, cover.enhanced, cover.sections, cover.covered, cover.progress) == (9, 4, 3, 3, 44)
    assert enrich.document_summary(done).first().summary.startswith("Sentence number 0 is here. Sentence number 1")


def test_replies(spark):
    replies = ['```json\n{"summary": "s", "entities": ["a", 1, null, {"b": 2}, "c"]}\n```', "nonsense", "[]", "null", '{"entities": ["x"], "relations": {"y": 1}}', ' {"summary": null, "relations": ["r"]} ', "5", None, "", '```JSON{"summary": "\u00e9"}```']
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, reply string")
    got = [r.x and tuple(r.x) for r in rows.select("k", enrich.parse_reply("reply").alias("x")).orderBy("k").collect()]
    assert got == [("s", ["a", "c"], []), None, ("", [], []), None, ("", ["x"], []), ("", [], ["r"]), ("", [], []), None, None, ("é", [], [])]


class Replies:
    """A backend that answers in JSON, fails for some chunks for good, and for others once in each task."""

    def __init__(self):
        self.seen = set()

    def __call__(self, title, text):
        if "broken" in text:
            raise OSError("no line")
        if "late" in text and title not in self.seen:
            self.seen.add(title)
            raise TimeoutError("slow")
        return '{"summary": "", "entities": ["E"]}' if "mute" in text else f'{{"summary": "about {title}", "entities": ["E"], "relations": ["R"]}}'


def test_a_backend_that_replies_and_fails(spark):
    chunks = chunk_rows(spark, [("d", k, f"t{k}", text, {"entities": ["A"]}) for k, text in enumerate(["fine", "broken", "late", "mute"])])
    got = {r.chunk_index: (r.summary, r.entities, r.links) for r in enrich.enrich(chunks, enrich.Retrying(Replies(), wait=0.01), parallel=2).collect()}
    assert got == {0: ("about t0", ["A", "E"], ["R"]), 1: (None, ["A"], []), 2: ("about t2", ["A", "E"], ["R"]), 3: (None, ["A", "E"], [])}
    told = {r.chunk_id: r.failure for r in enrich.asked(chunks.select("chunk_id", "title", "text"), Replies()).collect()}
    assert told == {"d#0": None, "d#1": "OSError: no line", "d#2": "TimeoutError: slow", "d#3": None}


def test_folders_are_sorted_as_people_sort(spark):
    rows = [("1", "zebra", None), ("2", "Äpfel", None), ("3", "apfel", None), ("4", "Zoo", None), ("5", "北京", None), ("6", "安全", None), ("7", "émile", "1"), ("8", "Eve", "1"), ("9", "eve", "1"), ("10", "lost", "gone")]
    df = spark.createDataFrame([(f, n, p, None, 1) for f, n, p in rows], S.FOLDERS)
    order = [r.folder_id for r in folders.display_order(df).orderBy("place").collect()]
    assert order == ["6", "5", "3", "2", "10", "1", "7", "9", "8", "4"] or order == ["3", "2", "10", "1", "7", "9", "8", "4", "6", "5"]
    plan = folders.ancestors(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "UnionLoop" in plan


def test_containment_of_many_in_many(spark):
    from itertools import product

    from tessera.operators import containment, search

    rng = __import__("random").Random(4)
    words = [""] + ["".join(rng.choice("ab漢é") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    names, queries = words[:80] + [None], words[60:] + ["x" * 12, None]
    rows = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    found = containment.containing(rows(names, "n"), rows(queries, "q"))
    want = {(n, q) for n, q in product(names, queries) if n is not None and q is not None and (n in q or q in n)}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    asked = spark.createDataFrame([(0, "ab漢")], "query_id int, text string")
    plan = search.named_documents(asked, doc_rows(spark, [("d", "ab漢é.pdf", None, None)]), spark.createDataFrame([], "query_id int, doc_id string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = spark.createDataFrame([(["abc", None, ""], ["b", "bc", "", None, "zz", "b"], ["B", "BC", "-", "n", "Z", "b"])], "t array<string>, p array<string>, n array<string>").select(containment.contained("t", "p", "n")).first()[0]
    assert got == [["B", "BC", "-", "b"], [], ["-"]]


def test_longest_contained(spark):
    from tessera.operators import containment

    rng = __import__("random").Random(5)
    text = lambda n: "".join(rng.choice("abé漢 ") for _ in range(n))
    ts = [text(300) for _ in range(6)] + [None, ""]
    ps = [ts[0][10:60], ts[0][10:90], ts[1][:40], "x" + ts[2][:50], ts[3][5:36], ts[3][5:37], ts[4], ts[4], None, text(40)]
    want = [max(((len(p), -k) for k, p in enumerate(ps) if p and len(p) >= 32 and t and p in t), default=None) for t in ts]
    got = spark.createDataFrame([(ts, ps)], "t array<string>, p array<string>").select(containment.longest_contained("t", "p")).first()[0]
    assert got == [None if w is None else -w[1] for w in want] and got[0] == 1 and got[4] == 6


def test_links_of_a_long_document_take_time_in_proportion(spark):
    import time

    from tessera.operators import chunking

    took = []
    for n in (600, 2400):
        text = "\n\n".join(f'The Quick{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} Fox met "term {k}" near term {k - 3} again. ' + "word " * 160 for k in range(n))
        df = spark.createDataFrame([("d", text)], "doc_id string, text string")
        best = []
        for _ in range(2):
            began = time.time()
            rows = chunking.local_chunks(df).select("links").collect()
            best.append(time.time() - began)
        took.append(min(best))
        assert len(rows) == n and sum(len(r.links) > 0 for r in rows) > n // 2
    assert took[1] < 8 * took[0] + 2


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>Word</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


FILES = [
    ("t", "a.txt", "", b"plain \xe4\xba\xba"), ("h", "a.html", "", b"<p>x</p>&nbsp;y"), ("j", "a.json", "", b'{"k": {"z": 1, "a": [true, null]}}'), ("bad", "b.json", "", b"{oops"),
    ("w", "a.docx", "", docx()), ("p", "a.pdf", "", b"%PDF-1.4 (Hello) Tj stream\n" + zlib.compress(b"(inner text) Tj") + b"endstream"), ("ph", "b.pdf", "", b" <!DOCTYPE html><p>web</p>"),
    ("pt", "c.pdf", "", b"just text"), ("c", "a.csv", "", b"a,b\n1,2"), ("u", "a.bin", "", b"who knows"),
]


def test_extraction(spark):
    df = spark.createDataFrame(FILES, "doc_id string, name string, mime string, content binary")
    got = {r.doc_id: r for r in extract.extract(df).collect()}
    assert {k: r.text for k, r in got.items()} == {"t": "plain 人", "h": "x y", "j": "k:   z: 1\n  a: true\nnull", "bad": "{oops", "w": "Hello Word\nSecond", "p": "Hello inner text", "ph": "web", "pt": "just text", "c": "a,b\n1,2", "u": "who knows"}
    assert got["ph"].warning and got["u"].warning and got["t"].warning is None
    good, bad = extract.uploads(df.withColumnRenamed("mime", "declared"))
    assert good.count() == 9 and [(r.name, r.reason) for r in bad.collect()] == [("a.bin", "unknown type")]


def test_bookmarks_and_legacy(spark, tmp_path):
    tree = [{"title": "One", "page": 1, "items": [{"title": " ", "page": 2, "items": [{"title": "Kept", "page": 3}]}]}]
    got = extract.flatten_bookmarks(spark.createDataFrame([("d", json.dumps(tree))], "doc_id string, bookmarks string")).first().outline
    assert [(e.level, e.title, e.page, e.path) for e in got] == [(1, "One", 1, None), (3, "Kept", 3, ["One"])]
    (tmp_path / "index.json").write_text(json.dumps({"version": 1, "docs": [{"id": "a"}], "chunks": [{"id": "a#0", "text": "t"}]}))
    docs, chunks, none = extract.read_legacy(spark, str(tmp_path / "index.json"))
    assert (docs.count(), chunks.first().text, none.count()) == (1, "t", 0)


def test_exports(spark, tmp_path):
    entries = [{"level": 1, "title": "Part One", "page": 1, "path": None}, {"level": 2, "title": "Sub", "page": 2, "path": ["Part One"]}]
    docs = doc_rows(spark, [("d", "Guide.md", None, entries), ("e", "Flat <x>.md", None, None)])
    chunks = chunk_rows(spark, [("d", 0, "Part One", "Part One\nbody one", {"page": 1, "entities": ["E1"]}), ("d", 1, "Sub", "body two", {"page": 2, "summary": "gist", "entities": ["E1", "E2"], "links": ["L"]}), ("e", 0, "Head", "text of head", {"heading": True})])
    md = {r.doc_id: r.markdown for r in export.markdown(docs, chunks).collect()}
    assert "## 1. Part One\n\n> 第 1 页 · 1 个片段" in md["d"] and "### 1.1. Sub" in md["d"] and "body one" in md["d"] and "Part One\nbody one" not in md["d"] and "**关联：** L" in md["d"]
    maps = {r.doc_id: r.mindmap for r in export.mind_map(docs, chunks).collect()}
    assert "- 小结：gist" in maps["d"] and "## 关键实体\n\n- E1（2）\n- E2（1）" in maps["d"] and "# Flat _x_" in maps["e"]
    short = {r.doc_id: r.mindmap for r in export.mind_map(docs, chunks, most=1).collect()}
    assert "其余 1 个章节已省略" in short["d"]
    names = sinks.export_names(doc_rows(spark, [("aaaaaaaa1", "x.md", None, None), ("bbbbbbbb2", "x.txt", None, None)]))
    assert {r.md_file for r in names.collect()} == {"x.md", "x-bbbbbb.md"}
    sinks.write_exports(export.markdown(docs, chunks).select(F.concat("doc_id", F.lit(".md")).alias("file"), F.col("markdown").alias("content")), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("file=*"))) == 2


def test_maps_of_long_outlines_say_so(spark):
    entries = [{"level": 1, "title": f"Part {k}", "page": k + 1, "path": None} for k in range(330)]
    docs = doc_rows(spark, [("d", "Long.pdf", None, entries), ("e", "Short.pdf", None, entries[:3])])
    chunks = chunk_rows(spark, [(d, k, f"Part {k}", "text", {"page": k + 1}) for d in "de" for k in range(3)])
    maps = {r.doc_id: r.mindmap for r in export.mind_map(docs, chunks).collect()}
    assert "- 提示：目录条目过多，已展开前 320 个章节\n- LLM 增强" in maps["d"] and "提示" not in maps["e"]
    labels = {r.doc_id: r.label for r in docs.select("doc_id", listing.outline_label("outline", F.lit("pdf-bookmarks")).alias("label")).collect()}
    assert labels == {"d": "结构：PDF 目录（书签） · 330 条 · 最深 1 级", "e": "结构：PDF 目录（书签） · 3 条 · 最深 1 级"}


def test_folded_sections_are_named(spark):
    entries = [{"level": 1 if k % 40 == 0 else 2, "title": f"S{k}", "page": k + 1, "path": None} for k in range(400)]
    docs = doc_rows(spark, [("d", "Deep.pdf", None, entries)])
    chunks = chunk_rows(spark, [("d", k, f"S{k}", "body", {"page": k + 1}) for k in range(2)])
    md = export.markdown(docs, chunks).first().markdown
    folded = "、".join(f"S{k}" for k in range(1, 13))
    assert f"**更深子节：** {folded} 等 39 节" in md


def test_old_stores_are_filled_in(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"docs": [{"id": "a", "pendingEnhance": 9}, {"id": "b"}], "chunks": [{"id": "a#0", "docId": "a", "text": "t", "summary": "s"}, {"id": "a#1", "docId": "a", "text": "u"}]}))
    docs, chunks, _ = extract.read_legacy(spark, str(tmp_path / "index.json"))
    got = {r.id: (r.chunkCount, r.enhancedChunks, r.pendingEnhance, r.folderId) for r in extract.backfilled(docs, chunks).collect()}
    assert got == {"a": (2, 1, 1, None), "b": (0, 0, 0, None)}


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "events"
    events = catalogue.P.status_events(spark, SF)
    events.repartition(4).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = {}
    q = lifecycle.track(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.update({r.doc_id: (r.status, r.events) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == {r.doc_id: (r.status, r.events) for r in lifecycle.latest(events).collect()}
    assert lifecycle.allowed("parsing", "error") and lifecycle.allowed(None, "queued") and not lifecycle.allowed("done", "parsing")


def test_ingest_and_facade(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "nat.md").write_text("# NAT Guide\n\nConfigure Source Nat with the address book first.")
    (files / "ips.txt").write_text("The Ips default action is an alarm. It may be changed to block.")
    (files / "skip.exe").write_text("no")
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    for _ in range(2):
        ingest.ingest(ingest.file_stream(spark, str(files)), kb.tables, str(tmp_path / "cp"), enrich.FirstSentence(), seconds=None).awaitTermination()
    assert kb.docs.count() == 2 and kb.chunks.count() == 2
    assert kb.search("source nat").first().doc_name == "nat.md"
    assert "命中 1 段" in kb.search_text("default action") and "没有找到" in kb.search_text("zzz") and "不能为空" in kb.search_text(" ")
    assert "匹配到以下文档" in kb.search_text("ips.txt")
    ips = kb.docs.filter("name = 'ips.txt'").first().doc_id
    kb.set_tags(ips, ["IPS ", "Fw"])
    assert [r.tag for r in kb.tags().collect()] == ["fw", "ips"]
    assert {r.doc_id for r in kb.search("action guide", tags=["ips", "nope"]).collect()} == {ips}
    assert kb.search("action", tags=["nope"]).count() == 0 and "没有文档带有标签" in kb.search_text("action", tags=["nope"])
    assert kb.list_documents(tag="ips").first().chunk_count == 1
    assert kb.read_document(ips, "junk", None).first().total == 1
    assert kb.ask("ips default source nat", lambda q, p: "Because [1].")["cited"] == [1]
    assert kb.ask_text("ips default source nat", lambda q, p: "Because [1].", "m").startswith("Because [1].\n\n引用：\n[1] ")
    assert kb.ask("default action", lambda q, p: "x") is None and kb.ask("ips source", lambda q, p: " ") is None
    assert kb.status().first().enhanced_docs == 2 and kb.graph()[0].count() > 2 and kb.exports(ips).count() == 1
    assert {r.file for r in kb.export_files(str(tmp_path / "exp"), ips).collect()} == {"ips.md", "ips.mindmap.md"}
    got = sinks.read_exports(spark, str(tmp_path / "exp"), spark.createDataFrame([("ips.md",)], "file string")).first()
    assert got.content == kb.exports(ips).first().markdown.rstrip("\n")
    assert kb.add_file("own", "vpn.txt", b"The tunnel needs a shared secret.") is None and kb.search("tunnel secret").first().doc_id == "own"
    assert kb.add_file("own", "vpn.txt", b"Rewritten words.") is None and kb.search("tunnel secret").count() == 0 and kb.add_file("x", "a.exe", b"?") == "unknown type"
    kb.delete_document("own")
    kb.create_folder("f", "Manuals")
    kb.file_document(ips, "f")
    kb.create_folder("g", "Inner", "f")
    kb.rename_folder("g", "Deep")
    kb.move_folder("g", None)
    kb.delete_folder("f")
    assert kb.docs.filter(F.col("doc_id") == ips).first().folder_id is None and kb.folders.count() == 1
    kb.delete_document(ips)
    assert kb.docs.count() == 1 and kb.chunks.count() == 1 and kb.search("default action").count() == 0
    assert string_list([" a ", 5, "", None, "b"]) == ["a", "b"] and string_list("ab") == string_list(None) == [] and flag(True) and not flag("yes") and flag(None, True)
    assert [bounded_int(x, 5, 1, 12) for x in (None, "7", 7.9, 99, -1, True, float("nan"))] == [5, 5, 7, 12, 1, 5, 5]


class Picky:
    """Summarises what has no x in it."""

    def __call__(self, title, text):
        return None if "x" in text else (f"about {title}", ["Entity"], [])


def run_tables(spark, path):
    tables = store.Tables(spark, str(path))
    docs = doc_rows(spark, [(d, f"{d}.md", None, None) for d in ("good", "bad", "half", "gone", "empty")])
    docs = docs.withColumn("status", F.when(F.col("doc_id") == "gone", "cancelled").otherwise("extracted"))
    tables.write("docs", docs)
    rows = [("good", k, f"t{k}", "fine") for k in range(5)] + [("bad", k, "t", "x") for k in range(2)] + [("half", 0, "t", "fine"), ("half", 1, "t", "x"), ("gone", 0, "t", "fine")]
    tables.write("chunks", chunk_rows(spark, rows))
    return tables


def test_runs_enrich_in_batches(spark, tmp_path):
    tables = run_tables(spark, tmp_path / "t")
    assert runs.run(tables, Picky(), budget=2) == 3
    docs = {r.doc_id: r for r in tables.read("docs", S.DOCS).collect()}
    assert {k: r.status for k, r in docs.items()} == {"good": "done", "bad": "done", "half": "done", "gone": "cancelled", "empty": "extracted"}
    assert docs["good"].progress == 100 and docs["good"].error is None and docs["good"].summary == "about t0 about t1 about t2 about t3 about t4"
    assert docs["bad"].error == docs["half"].error == runs.NO_RESULT and docs["bad"].warning.startswith(runs.NOTE + "0/2")
    assert docs["half"].warning.startswith(runs.NOTE + "1/2")
    done = {r.chunk_id for r in tables.read("chunks", S.CHUNKS).filter("summary is not null").collect()}
    assert done == {*(f"good#{k}" for k in range(5)), "half#0"}
    assert runs.run(tables, enrich.FirstSentence()) == 1
    again = {r.doc_id: r for r in tables.read("docs", S.DOCS).collect()}
    assert again["bad"].error is None and again["bad"].warning is None and again["gone"].status == "cancelled"


def test_runs_cancel_and_resume(spark, tmp_path):
    tables = run_tables(spark, tmp_path / "t")
    one = lambda d, status: runs.patch_docs(tables, spark.createDataFrame([(d, status)], "doc_id string, status string"))
    one("good", "enriching")
    one("half", "done")
    status = lambda: {r.doc_id: r.status for r in tables.read("docs", S.DOCS).collect()}
    assert status()["half"] == "extracted"
    runs.cancel(tables, spark.createDataFrame([("good",), ("bad",)], "doc_id string"))
    assert status()["good"] == "cancelled" and status()["bad"] == "extracted"
    one("half", "enriching")
    assert [(r.doc_id, r.phase) for r in runs.resume(tables).collect()] == [("half", "enrich")] and status()["half"] == "queued"


def test_followed_refuses(spark):
    rows = [("a", k, k, s) for k, s in enumerate(["queued", "done", "extracting", "parsing", "queued", "extracted"])]
    got = lifecycle.followed(spark.createDataFrame(rows, "doc_id string, ts long, event_id long, status string")).first()
    assert (got.status, got.refused) == ("extracted", 2)


def test_ingested_documents_have_outlines(spark, tmp_path, monkeypatch):
    """Headings of texts, bookmarks and edge lines of paged files, by way of a stand-in for a PDF reader."""
    pages = [f"Head\ntext {k}\nmore\nlines\nhere\nbody {k}\n- {k} -" for k in range(24)]
    marks = '[{"title": "Part", "page": 1, "items": [{"title": " ", "items": [{"title": "Deep", "page": 9}]}]}]'
    files = spark.createDataFrame([("t", "a.md", "text/markdown", b"# One\n## Two\ntext\n### Three\nmore"), ("n", "b.txt", "text/plain", b"no headings")], "doc_id string, name string, mime string, content binary")
    paged = spark.createDataFrame([("p", "\n".join(pages), pages, None, marks)], "doc_id string, text string, pages array<string>, warning string, bookmarks string")
    whole = extract.extract(files).unionByName(paged)
    monkeypatch.setattr(extract, "extract", lambda _: whole)
    got = {r.doc_id: r for r in ingest.documents_of(files).collect()}
    assert [(e.level, e.title) for e in got["t"].outline] == [(1, "One"), (2, "Two"), (3, "Three")] and got["t"].outline_source == "text-headings"
    assert got["n"].outline == [] and got["n"].outline_source is None
    assert [(e.level, e.title, e.page, e.path) for e in got["p"].outline] == [(1, "Part", 1, None), (3, "Deep", 9, ["Part"])]
    assert got["p"].outline_source == "pdf-bookmarks" and "Head" not in got["p"].text and "body 3" in got["p"].pages[3] and "- 3 -" not in got["p"].pages[3]
    chunks = chunking.build_chunks(ingest.documents_of(files)).filter("doc_id = 'p'").collect()
    assert [(c.title, c.section_path, c.page) for c in chunks] == [("Part", ["Part"], 1)]


def test_listing(spark):
    docs = doc_rows(spark, [("1", "NAT guide", ["a"], None), ("2", "other", ["nat x"], None), ("3", "none", None, None)])
    assert {r.doc_id for r in docs.filter(listing.name_or_tag("Nat")).collect()} == {"1", "2"}
    assert {r.doc_id for r in docs.filter(listing.has_tag(" A ")).collect()} == {"1"} and docs.filter(listing.name_like(None)).count() == 3
    assert [r.tag for r in listing.tag_suggestions(docs, ["nat x"]).collect()] == ["nat x", "a"]
    rows = listing.document_rows(docs.withColumn("progress", F.lit(140)).withColumn("chunk_count", F.lit(None).cast("long")).withColumn("enhanced_chunks", F.lit(0)))
    assert {(r.progress, r.chunk_count, r.summary) for r in rows.collect()} == {(100, 0, "")}


def test_section_chunks_keep_all_text(spark):
    got = collections.Counter()
    for r in catalogue.QUERIES["section_chunks_pages"](spark, SF).collect():
        got[r.chunk_id.split("#")[0]] += len("".join(r.text.split()))
    want = spark.read.parquet(f"{SF}/conversations.parquet").groupBy("conv_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n"))
    assert got == {str(r.conv_id): r.n for r in want.collect()}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, tmp_path, name):
    out = str(tmp_path / "out")
    catalogue.QUERIES[name](spark, SF).write.parquet(out)
    if name not in catalogue.ORACLE:
        assert db.execute(f"select count(*) from '{out}/*.parquet'").fetchone()[0] > 0
        return
    db.execute(f"create or replace table want as {catalogue.ORACLE[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in sorted(db.execute("describe want").fetchall()))
    got = f"select {columns} from '{out}/*.parquet'"
    assert db.execute(f"select * from (select {columns} from want except all {got})").fetchall() == []
    assert db.execute(f"select * from ({got} except all select {columns} from want)").fetchall() == []
