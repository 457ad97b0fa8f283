"""Text, chunks, outlines, index and search on literal rows."""

import pytest
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import chunking, graph, index, outline, reading, search, store


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def chunk_rows(spark, rows):
    """rows: doc_id, index, title, text, and any further columns by name."""
    full = []
    for doc, k, title, text, *more in rows:
        m = more[0] if more else {}
        full.append((doc, k, f"{doc}#{k}", title, text, len(text) // 4, m.get("entities", []), m.get("links", []), m.get("summary"), m.get("heading"), m.get("page"), m.get("path")))
    return spark.createDataFrame(full, S.CHUNKS)


def doc_rows(spark, rows):
    """rows: doc_id, name, tags, outline."""
    return spark.createDataFrame([(d, n, n, "text/plain", 10, None, "done", 100, None, None, None, o, None, t, None) for d, n, t, o in rows], S.DOCS)


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("源 NAT", ["源", "nat"]), ("源地址", ["源", "源地", "地", "地址", "址"]), ("802.1Q vlan10 Egress", ["802.1q", "vlan10", "egress"]), ("，。、！", []), (None, []), ("end. -x v1.2-", ["end", "x", "v1.2"])],
)
def test_tokenize(spark, text, tokens):
    assert value(spark, X.tokenize(F.lit(text))) == tokens


def test_chunk_tokens_weight_fields(spark):
    got = value(spark, X.chunk_tokens(F.lit("Ab"), F.lit("cd"), F.lit("w " * 500), F.array(*[F.lit(f"e{k}") for k in range(30)])))
    assert got.count("ab") == 3 and got.count("cd") == 2 and got.count("w") == 400 and sum(t[0] == "e" for t in got) == 24


@pytest.mark.parametrize(
    ("line", "heading"),
    [("# Title", True), ("3.1 安全域", True), ("第三章 概述", True), ("3 个接口，", False), ("plain", False), ("", False), (None, False), ("#" * 101, False), ("1. ok then", True), ("2 x", False)],
)
def test_heading_lines(spark, line, heading):
    assert value(spark, X.is_heading_line(F.lit(line))) is heading


def test_names_and_clips(spark):
    assert value(spark, X.clean_heading(F.lit("## 安全域 ...... 12"))) == "安全域"
    assert value(spark, X.title_from(F.lit("\nx"))) == X.UNTITLED
    assert len(value(spark, X.title_from(F.lit("y" * 80)))) == 58
    assert value(spark, X.sanitize_base(F.lit("..a:b?.md"))) == "a_b_"
    assert value(spark, X.format_bytes(F.lit(1280))) == "1.3 KB"
    assert value(spark, X.first_sentence(F.lit("A long sentence. Another one."))) == "A long sentence."
    assert value(spark, X.body_of(F.lit("T"), F.lit("## T\nbody"))) == "body"
    assert value(spark, X.normalize_tags(F.array(*[F.lit(t) for t in [" A  b ", "a B", "", "x" * 33, *map(str, range(30))]]))) == ["a b", "x" * 32, *map(str, range(18))]
    assert value(spark, X.folder_name(F.lit(" a/b  c "))) == "ab c"
    assert value(spark, X.folder_name(F.lit("x" * 61))) is None
    assert value(spark, X.strip_html(F.lit("<SCRIPT>x</script>a<b>c</b>&nbsp;&amp;lt;"))) == "a c <"


def test_entities_and_ties(spark):
    got = value(spark, X.entities(F.lit('Zeta Beta then Alpha. Alpha "quoted term" The 安全域，安全域')))
    assert got == ["Alpha", "安全", "全域", "安全域", "Zeta Beta", "quoted term"]
    assert value(spark, X.entities(F.lit(None).cast("string"))) == []


def test_snippet_centres_on_terms(spark):
    text = "x" * 1000 + " needle " + "y" * 1000
    got = value(spark, X.snippet(F.lit(text), F.array(F.lit("needle"))))
    assert "needle" in got and got[0] == "…" and got[-1] == "…" and len(got) <= 702
    assert value(spark, X.snippet(F.lit(text))) == text[:700] + "…"


def test_chunk_text(spark):
    cut = lambda t: value(spark, chunking.chunk_text(F.lit(t)))
    assert cut("a  b\r\n\r\nc") == ["a b\n\nc"]
    assert [len(x) for x in cut("z" * 1201)] == [900, 301]
    assert [len(x) for x in cut("z" * 1200)] == [1200]
    assert cut("p" * 500 + "\n\n" + "q" * 500) == ["p" * 500, "q" * 500]
    assert cut(" ") == [] and cut(None) == []
    long_ = "\n\n".join(chr(97 + k) * (50 * k + 1) for k in range(26))
    assert "".join("".join(cut(long_)).split()) == "".join(long_.split())


def manual():
    """17 pages: a title, four chapters, three sections each."""
    pages, entries = ["cover " + "x" * 330], [{"level": 1, "title": "Manual", "page": 1, "path": None}]
    for c in range(4):
        entries.append({"level": 2, "title": f"Chapter {c}", "page": 2 + 4 * c, "path": None})
        pages.append(f"Chapter {c} intro " + "i" * 330)
        for k in range(3):
            entries.append({"level": 3, "title": f"Section {c}-{k}", "page": 3 + 4 * c + k, "path": [f"Chapter {c}"]})
            pages.append(f"Section {c}-{k} " + "b" * 330)
    return pages, entries


def test_page_chunks_follow_sections(spark):
    pages, entries = manual()
    df = spark.createDataFrame([("m", None, pages, entries)], "doc_id string, text string, pages array<string>, outline array<struct<level:int,title:string,page:int,path:array<string>>>")
    rows = chunking.build_chunks(df).orderBy("chunk_index").collect()
    assert len(rows) == 17 and all(r.heading for r in rows)
    third = rows[2]
    assert (third.page, third.title, third.section_path) == (3, "Section 0-0", ["Chapter 0", "Section 0-0"])
    joined = "".join("".join(r.text.split()) for r in rows)
    assert joined == "".join("".join(p.split()) for p in pages)


def test_section_tree_owns_each_chunk_once(spark):
    pages, entries = manual()
    df = spark.createDataFrame([("m", None, pages, entries)], "doc_id string, text string, pages array<string>, outline array<struct<level:int,title:string,page:int,path:array<string>>>")
    chunks = chunking.build_chunks(df)
    docs = doc_rows(spark, [("m", "Manual.pdf", None, entries)])
    nodes, owned = outline.section_tree(docs, chunks)
    assert owned.count() == owned.select("doc_id", "chunk_index").distinct().count() == 17
    nodes, owned = outline.unwrap_title(docs, nodes, owned)
    assert owned.count() == 17
    numbered = {r.title: r.number for r in outline.numbering(nodes).collect()}
    assert "Manual" not in numbered and numbered["Chapter 3"] == "4" and numbered["Section 2-1"] == "3.2"
    gap = doc_rows(spark, [("m", "Other", None, [e for e in entries if e["page"] >= 5])])
    nodes, owned = outline.section_tree(gap, chunks)
    assert owned.filter("node_no = -1").count() == 4 and owned.count() == 17


def test_title_cursor_moves_forward(spark):
    chunks = chunk_rows(spark, [("d", 0, "", "intro beta"), ("d", 1, "", "al pha text"), ("d", 2, "", "more"), ("d", 3, "", "beta here"), ("d", 4, "", "x")])
    nodes = spark.createDataFrame([("d", 0, "alpha"), ("d", 1, "beta"), ("d", 2, "gone"), ("d", 3, "z")], "doc_id string, node_no int, title string")
    got = {r.chunk_index: r.node_no for r in outline.assign_by_title(chunks, nodes).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_asof_cursor_with_unordered_pages(spark):
    chunks = chunk_rows(spark, [("d", k, "", "t", {"page": p}) for k, p in enumerate([1, 4, 2, 9])])
    nodes = spark.createDataFrame([("d", 0, 2), ("d", 1, 8), ("d", 2, 3)], "doc_id string, node_no int, page int")
    assert {r.chunk_index: r.node_no for r in outline.assign_by_page(chunks, nodes).collect()} == {1: 0, 2: 0, 3: 2}


def test_detect_outline(spark):
    text = "# One\n```\n# no\n```\n1.2 Two words\n###### Deep\nplain\n第三章 末尾"
    df = spark.createDataFrame([("a", text), ("b", "# x1\n# y2"), ("c", None)], "doc_id string, text string")
    got = [(r.doc_id, r.level, r.title) for r in outline.detect_outline(df).orderBy("seq").collect()]
    assert got == [("a", 1, "One"), ("a", 2, "Two words"), ("a", 4, "Deep"), ("a", 1, "末尾")]


def test_furniture(spark):
    pages = [["Head", f"text {k}", "more", "lines", "here", f"body {k}", f"- {k} -"] for k in range(24)]
    out = outline.strip_furniture(spark.createDataFrame([("d", pages), ("s", pages[:5])], "doc_id string, pages array<array<string>>"))
    got = {r.doc_id: r.pages for r in out.collect()}
    assert got["s"] == pages[:5]
    assert all("Head" not in p and f"- {k} -" not in p for k, p in enumerate(got["d"]))


@pytest.fixture(scope="module")
def manual_docs(spark):
    docs = doc_rows(spark, [("d1", "CLI 手册.md", ["命令行", "安全策略"], None), ("d2", "WebUI 指南.md", ["webui"], None), ("faq", "地址簿", None, None)])
    chunks = chunk_rows(
        spark,
        [
            ("d1", 0, "NAT 概述", "NAT 将地址进行转换，是常见的网络功能。", {"entities": ["NAT", "地址"], "summary": "介绍 NAT", "page": 1, "path": ["NAT", "概述"]}),
            ("d1", 1, "源 NAT 配置步骤", "配置源 NAT 的步骤：先创建地址簿，然后配置源 NAT 规则。", {"entities": ["源 NAT", "地址簿"], "page": 2}),
            ("d1", 2, "IPS 默认动作", "IPS 策略的默认动作是告警，可以改为阻断。", {"entities": ["IPS", "nat"], "page": 3}),
            ("d1", 3, "会话管理", "会话超时时间的设置，以及查看会话。", {"page": 4}),
            ("d2", 0, "登录", "通过浏览器登录 WebUI 页面。" + "长" * 800, {"page": 1}),
        ],
    )
    return docs, chunks.persist(), index.build_index(chunks)


def ask(spark, data, text, **options):
    docs, chunks, idx = data
    return search.search(idx, chunks, docs, spark.createDataFrame([(0, text)], "query_id long, text string"), **options).orderBy("rank").collect()


def test_search_ranks(spark, manual_docs):
    hits = ask(spark, manual_docs, "源 NAT 怎么配置")
    assert hits[0].chunk_id == "d1#1" and hits[0].score == 1.0 and all(0 < h.score <= 1 for h in hits)
    assert ask(spark, manual_docs, "IPS 默认动作是什么")[0].chunk_id == "d1#2"
    assert ask(spark, manual_docs, "kubernetes helm chart") == [] and ask(spark, manual_docs, " ") == []


def test_search_scopes_keep_global_statistics(spark, manual_docs):
    assert {h.doc_id for h in ask(spark, manual_docs, "配置 登录", tags=["WebUI"])} == {"d2"}
    assert {h.doc_id for h in ask(spark, manual_docs, "登录 配置", doc_id="d1")} == {"d1"}
    whole = {h.chunk_id: h.score for h in ask(spark, manual_docs, "NAT 地址", top_k=12)}
    one = {h.chunk_id: h.score for h in ask(spark, manual_docs, "NAT 地址", doc_id="d1", top_k=12)}
    assert one == {k: v for k, v in whole.items() if k.startswith("d1")}


def test_search_short_terms_and_snippets(spark, manual_docs):
    assert ask(spark, manual_docs, "源") == [] and ask(spark, manual_docs, "源", strict=False)
    hit = ask(spark, manual_docs, "WebUI 页面")[0]
    assert hit.snippet.endswith("…") and len(hit.snippet) == 701
    assert len(ask(spark, manual_docs, "nat 地址 会话 配置", top_k=99)) <= 12


def test_rare_terms_beat_common_ones(spark):
    rows = [(f"c{k}", 0, "common", "shared words about network settings") for k in range(30)] + [("rare", 0, "rare", "路由反射器 network settings")]
    chunks = chunk_rows(spark, rows)
    docs = doc_rows(spark, [(r[0], r[0], None, None) for r in rows])
    assert ask(spark, (docs, chunks, index.build_index(chunks)), "路由反射器怎么配 network")[0].doc_id == "rare"


def test_named_documents(spark, manual_docs):
    docs = manual_docs[0]
    q = spark.createDataFrame([(0, "地址簿"), (1, "地址簿怎么用"), (2, "地 址"), (3, "x")], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, doc_id string")
    assert [(r.query_id, r.doc_id) for r in search.named_documents(q, docs, none).collect()] == [(0, "faq")]
    hit = spark.createDataFrame([(0, "faq")], "query_id long, doc_id string")
    assert search.named_documents(q, docs, hit).count() == 0


def hits_of(found):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9), tuple(r.terms)) for r in found.collect())


def test_readding_a_document_changes_nothing(spark, manual_docs, tmp_path):
    _, chunks, idx = manual_docs
    made = index.Segments(spark, str(tmp_path / "i"), 4)
    for ids in (["d1", "d2", "faq"], ["d1"], ["d1", "faq"]):
        made.add(chunks, spark.createDataFrame([(d,) for d in ids], "doc_id string"))
    again = made.index()
    as_set = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    for df, other, c in ((again.postings, idx.postings, ["term", "chunk_id", "tf", "length"]), (again.frequencies, idx.frequencies, ["term", "df"]), (again.lengths, idx.lengths, ["chunk_id", "length"])):
        assert as_set(df, *c) == as_set(other, *c)
    assert made.stats() == idx.stats()
    assert {r.segment: r.documents for r in made.segments().collect()} == {1: 3, 2: 1, 3: 2}
    written = lambda n: sum(p.stat().st_size for p in (tmp_path / "i").rglob(f"*/segment={n}/**/*.parquet"))
    assert written(2) < written(1)
    assert made.merge() == 3
    assert made.segments().count() == 1 and not (tmp_path / "i/postings/segment=1").exists()
    assert as_set(made.index().postings, "term", "chunk_id", "tf") == as_set(idx.postings, "term", "chunk_id", "tf") and made.stats() == idx.stats()
    made.add(chunks.limit(0), spark.createDataFrame([("d1",), (None,), ("unknown",)], "doc_id string"))
    assert made.index().postings.filter("doc_id = 'd1'").count() == 0 and made.stats()[0] == chunks.filter("doc_id != 'd1'").count()


def test_index_of_nothing(spark, manual_docs, tmp_path):
    made = index.Segments(spark, str(tmp_path / "i"), 4)
    terms = search.query_terms(spark.createDataFrame([(0, "source nat")], "query_id int, text string"))
    assert search.best(made, terms).count() == 0 and made.stats() == (1, 0.0) and made.merge() == 0
    made.add(manual_docs[1].withColumn("text", F.lit("")).withColumn("title", F.lit("")).withColumn("summary", F.lit(None).cast("string")).withColumn("entities", F.array().cast("array<string>")), manual_docs[1].select("doc_id"))
    assert search.best(made, terms).count() == 0 and made.stats() == (manual_docs[1].count(), 0.0)


def test_pruned_search_finds_what_full_scores_rank(spark, tmp_path):
    import random

    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(120)]
    draw = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.06)), 119)] for _ in range(n))
    chunks = chunk_rows(spark, [(f"d{k // 3}", k % 3, draw(2), draw(rng.randrange(3, 60))) for k in range(450)])
    idx = index.build_index(chunks)
    made = index.Segments(spark, str(tmp_path / "i"), 8)
    even = F.col("doc_id").isin([f"d{k}" for k in range(0, 150, 2)])
    made.add(chunks.withColumn("text", F.lit("w1 w2 w119")), chunks.select("doc_id").filter(~even))
    for part in (even, ~even):
        made.add(chunks, chunks.select("doc_id").filter(part))
    queries = search.query_terms(spark.createDataFrame([(k, draw(rng.randrange(1, 9))) for k in range(12)] + [(99, "w119 w118")], "query_id int, text string"))
    docs = chunks.select("doc_id").distinct().filter("doc_id < 'd4'")
    for options in ({}, {"top_k": 12}, {"docs": docs}, {"least": 4.0}):
        ranked = {k: v for k, v in options.items() if k != "docs"}
        want = hits_of(search.Asked.of(idx, queries, None, options.get("docs")).with_terms(search.ranked(search.scores(idx, queries, docs=options.get("docs")), **ranked)))
        assert hits_of(search.best(made, queries, at_once=0, **options)) == hits_of(search.best(made, queries, **options)) == want
    near = made.narrowed(["w119"], [r[0] for r in spark.range(1).select(index.bucket_of(F.lit("w119"), 8)).collect()])
    plan = near.postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(term,w119)" in plan


def test_tables_change_buckets_only(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path / "t"), 8)
    chunks = chunk_rows(spark, [(f"d{k}", 0, "t", f"text no{k}") for k in range(40)])
    tables.write("chunks", chunks)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t/chunks").rglob("*.parquet")}
    before = files()
    tables.patch_chunks(chunk_rows(spark, [("d7", 0, "t", "other words"), ("d7", 1, "t", "more")]))
    changed = {p.parent.name for p in before.keys() ^ files().keys()}
    assert len(changed) == 1
    assert {r.chunk_id: r.text for r in tables.read("chunks", S.CHUNKS, ["d7", "d9"]).collect()} == {"d7#0": "other words", "d7#1": "more", "d9#0": "text no9"}
    plan = tables.read("chunks", S.CHUNKS, ["d7"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    ask = lambda t: [r.chunk_id for r in search.best(tables.segments(), search.query_terms(spark.createDataFrame([(0, t)], "query_id int, text string"))).collect()]
    assert ask("other") == ["d7#0"] and ask("no7") == []
    tables.put_chunks(chunks.limit(0), spark.createDataFrame([("d7",), ("d8",)], "doc_id string"))
    assert tables.read("chunks", S.CHUNKS).count() == 38 and ask("other") == [] and ask("no9") == ["d9#0"]
    tables.write("chunks", chunks.limit(0))
    assert tables.read("chunks", S.CHUNKS).count() == 0 and ask("no9") == []


def test_two_writers_take_turns(spark, tmp_path):
    tables, other = (store.Tables(spark, str(tmp_path / "t"), 4) for _ in range(2))
    docs = doc_rows(spark, [(d, d, None, None) for d in "abc"])
    tables.write("docs", docs)

    def meet(rows):
        with pytest.raises(store.Busy):
            other.change("docs", S.DOCS, lambda d: d.limit(0), wait=0.3)
        return rows.withColumn("name", F.lit("new"))

    tables.change("docs", S.DOCS, meet, docs.select("doc_id").limit(1))
    other.change("docs", S.DOCS, lambda d: d.withColumn("mime", F.lit("x")))
    assert sorted((r.name, r.mime) for r in other.read("docs", S.DOCS).collect()) == sorted([("new", "x"), ("b", "x"), ("c", "x")])
    with pytest.raises(ZeroDivisionError):
        tables.change("docs", S.DOCS, lambda d: 1 / 0)
    tables.change("docs", S.DOCS, lambda d: d.filter("doc_id = 'b'"))
    assert other.read("docs", S.DOCS).count() == 1


def test_citations(spark):
    got = value(spark, search.cited_passages(F.lit("a [2][2] [10] [0] [x] [1]"), F.lit(9)))
    assert got == [1, 2]


def test_passages_and_rendering(spark, manual_docs):
    hits = search.search(manual_docs[2], manual_docs[1], manual_docs[0], spark.createDataFrame([(0, "NAT 概述")], "query_id long, text string"))
    text = search.passages(hits).first()
    assert text.passages.startswith("[1] 文档：CLI 手册.md（标签：命令行、安全策略）\n章节：NAT / 概述（第 1 页）\n小结：介绍 NAT\n正文：")
    shown = search.render_hits(hits).first().markdown
    assert shown.startswith("1. **NAT 概述**（CLI 手册.md · p.1 · NAT / 概述）\n   - 标签：命令行、安全策略\n   - 摘要：介绍 NAT\n   - 实体：NAT、地址")


def test_reading(spark, manual_docs):
    chunks = chunk_rows(spark, [("d", 0, "A", "one"), ("d", 1, "A", "two"), ("d", 2, "B", "three", {"page": 3})])
    page = reading.read_pages(chunks, 1, 40).first()
    assert page.content == "## A\n\none\ntwo\n\n## B（第 3 页）\n\nthree" and page.section_titles == ["A", "B"] and not page.has_more
    assert reading.read_pages(chunks, 1, 1).first().has_more and reading.read_pages(chunks, 9, 8).count() == 0
    big = reading.read_pages(chunk_rows(spark, [("d", k, f"t{k}", "z" * 1200) for k in range(15)]), 1, 40).first()
    assert big.truncated and len(big.content) == 12_002


def test_graph(spark, manual_docs):
    docs, chunks, _ = manual_docs
    nodes = {r.id: r for r in graph.graph_nodes(docs, chunks).collect()}
    assert nodes["e:nat"].weight == 2 and nodes["e:nat"].label == "NAT" and nodes["d:d1"].weight == 4 and nodes["d:faq"].weight == 0
    pipes = chunk_rows(spark, [("p", 0, "", "", {"entities": ["a|b", "c", "C"]})])
    assert [(r.source, r.target, r.weight) for r in graph.relates_edges(pipes).collect()] == [("e:a|b", "e:c", 1)]
    assert graph.raw_contains_edges(pipes).count() == 3
    edges = graph.graph_edges(chunks)
    top, kept = graph.capped(graph.graph_nodes(docs, chunks), edges, 3, 2)
    assert top.count() == 3 and kept.count() <= 2
    placed = graph.degree_slice(graph.graph_nodes(docs, chunks), edges, 2, focus="IPS")
    assert placed.count() == 2 and placed.filter("id = 'e:ips'").count() == 1
    assert sum(graph.ring(k)[1] for k in range(4)) == 236 and graph.ring_layout(placed).count() == 2
    assert {r.id for r in graph.neighbours(edges, "d:d1").collect()} >= {"d:d1", "e:nat"}


def test_store_changes(spark, tmp_path):
    chunks = chunk_rows(spark, [("a", 0, "t", "x"), ("a", 1, "t", "y"), ("b", 0, "t", "z")])
    patch = chunk_rows(spark, [("a", 1, "t", "Y"), ("c", 0, "t", "n")])
    assert {r.chunk_id: r.text for r in store.merge_chunks(chunks, patch).collect()} == {"a#0": "x", "a#1": "Y", "b#0": "z", "c#0": "n"}
    assert {r.chunk_id for r in store.set_chunks(chunks, patch).collect()} == {"a#1", "b#0", "c#0"}
    once = store.merge_chunks(chunks, patch)
    assert sorted(map(tuple, store.merge_chunks(once, patch).collect())) == sorted(map(tuple, once.collect()))
    tables = store.Tables(spark, str(tmp_path / "t"))
    assert tables.read("chunks", S.CHUNKS).count() == 0
    tables.write("chunks", chunks)
    tables.change("chunks", S.CHUNKS, lambda old: store.merge_chunks(old, patch))
    assert tables.read("chunks", S.CHUNKS).count() == 4


def test_summaries_carry_over(spark):
    old = chunk_rows(spark, [("d", 0, "", "a" * 400, {"summary": "long"}), ("d", 1, "", "short", {"summary": "tiny"}), ("d", 2, "", "b" * 350, {"summary": "b"})])
    new = chunk_rows(spark, [("d", 0, "", "x" + "a" * 400 + "b" * 350), ("d", 1, "", "short"), ("d", 2, "", "has short in it"), ("e", 0, "", "short")])
    got = {r.chunk_id: r.summary for r in store.carry_summaries(new, old).collect()}
    assert got == {"d#0": "long", "d#1": "tiny", "d#2": None, "e#0": None}
