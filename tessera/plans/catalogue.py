"""Every query by name over the driver's tables, each with SQL that computes the same where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import chunking, enrich, entities, export, folders, graph, index, listing, outline, reading, search, store
from tessera.plans import base as P
from tessera.sources import extract
from tessera.storage import new_path, spread, stored
from tessera.streaming import lifecycle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _long(c: str | F.Column) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _joined(c: str | F.Column, sep: str = "|") -> F.Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


def _round(c: str | F.Column) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- sources ---------------------------------------------------------------------------------

_HTML = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_ENTITIES = f"replace(replace(replace(replace({_HTML}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"


@query("html_strip_text", f"SELECT page_id, {P.trim(P.squeeze(_ENTITIES))} AS text FROM pages")
def _(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", X.strip_html("html").alias("text"))


@query(
    "mime_resolve",
    """WITH u AS (SELECT page_id, ['a.txt', 'b.MD', 'c.html', 'd.csv', 'e.pdf', 'f.docx', 'g.json', 'h.exe'][page_id % 8 + 1] AS name, ['text/plain', '', 'application/x-thing'][page_id % 3 + 1] AS declared FROM pages)
    SELECT page_id, name, CASE WHEN declared = 'text/plain' THEN 'text/plain' ELSE CASE lower(string_split(name, '.')[2]) WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html' WHEN 'csv' THEN 'text/csv'
      WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'json' THEN 'application/json' END END AS mime FROM u""",
)
def _(spark, sf):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("page_id") % len(xs) + 1).cast("int"))
    u = P.table(spark, sf, "pages").select("page_id", pick(["a.txt", "b.MD", "c.html", "d.csv", "e.pdf", "f.docx", "g.json", "h.exe"]).alias("name"), pick(["text/plain", "", "application/x-thing"]).alias("declared"))
    return u.select("page_id", "name", extract.mime_of("declared", "name").alias("mime"))


@query("html_sniff", r"SELECT page_id, regexp_matches(lower(substr(html, 1, 4096)), '<!doctype\s+html|<html[\s>]|<head[\s>]|<body[\s>]|<title[\s>]') AS is_html, contains(substr(html, 1, 1024), '%PDF-') AS is_pdf FROM pages")
def _(spark, sf):
    rows = P.table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return rows.select("page_id", extract.looks_like_html("content").alias("is_html"), extract.looks_like_pdf("content").alias("is_pdf"))


@query("extract_route", "SELECT CAST(page_id AS VARCHAR) AS doc_id, " + P.trim(P.squeeze(_ENTITIES)) + " AS text, CASE WHEN page_id % 2 = 1 THEN 'declared as PDF, read as the HTML that it is' END AS warning FROM pages")
def _(spark, sf):
    name = F.when(F.col("page_id") % 2 == 1, F.lit("a.pdf")).otherwise(F.lit("a.html"))
    files = P.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc_id"), name.alias("name"), F.lit("").alias("mime"), F.encode("html", "UTF-8").alias("content"))
    return extract.extract(files).select("doc_id", "text", "warning")


@query("json_flatten_props", "SELECT event_id, 'k: ' || (props->>'k') AS text FROM events")
def _(spark, sf):
    flat = F.pandas_udf(lambda s: s.map(extract.flatten_json), T.StringType())
    return P.table(spark, sf, "events").select("event_id", flat("props").alias("text"))


@query("upload_checks", "SELECT reason, count(*) AS files FROM (SELECT CASE WHEN page_id % 4 = 3 THEN 'unknown type' WHEN page_id % 4 = 2 THEN 'empty' ELSE 'accepted' END AS reason FROM pages) GROUP BY reason")
def _(spark, sf):
    p = P.table(spark, sf, "pages")
    name = F.when(F.col("page_id") % 4 == 3, F.lit("a.exe")).otherwise(F.lit("a.html"))
    content = F.when(F.col("page_id") % 4 == 2, F.lit("")).otherwise(F.col("html"))
    good, bad = extract.uploads(p.select(name.alias("name"), F.lit(None).cast("string").alias("declared"), F.encode(content, "UTF-8").alias("content")))
    return good.select(F.lit("accepted").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("files"))


# ---- chunks and outlines ---------------------------------------------------------------------


@query("force_split_chunks", f"SELECT doc_id, i AS piece_no, piece FROM (SELECT doc_id, unnest(ps) AS piece, CAST(unnest(range(0, len(ps))) AS INTEGER) AS i FROM (SELECT doc_id, list_filter(list_transform(range(0, greatest(1, CAST(ceil(length(text) / 900) AS BIGINT))), lambda i: {P.trim('substr(text, i * 900 + 1, 900)')}), lambda x: x <> '') AS ps FROM documents))")
def _(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.force_split(F.col("text"))).alias("piece_no", "piece"))


_GREEDY = f"""
WITH RECURSIVE b AS (SELECT doc_id, list_filter(list_transform(string_split({P.trim("regexp_replace(text, '[ \\t]+', ' ', 'g')")}, chr(10)), lambda x: {P.trim("x")}), lambda x: x <> '') AS bs FROM documents),
r AS (SELECT doc_id, bs, 0 AS i, '' AS cur, []::VARCHAR[] AS outs FROM b
UNION ALL SELECT doc_id, bs, i + 1, CASE WHEN length(x) > 1200 OR length(grown) >= 900 THEN '' ELSE grown END,
  CASE WHEN length(x) > 1200 THEN list_concat(outs, list_concat(CASE WHEN cur <> '' THEN [cur] ELSE [] END, list_filter(list_transform(range(0, CAST(ceil(length(x) / 900) AS BIGINT)), lambda k: {P.trim("substr(x, k * 900 + 1, 900)")}), lambda y: y <> '')))
    WHEN length(grown) >= 900 THEN list_concat(flushed, [grown]) ELSE flushed END
  FROM (SELECT *, CASE WHEN over THEN '' ELSE cur END || CASE WHEN over OR cur = '' THEN '' ELSE chr(10) || chr(10) END || x AS grown, CASE WHEN over THEN list_concat(outs, [cur]) ELSE outs END AS flushed
    FROM (SELECT *, bs[i + 1] AS x, length(cur) + length(bs[i + 1]) > 900 AND length(cur) > 0 AS over FROM r WHERE i < len(bs))))
SELECT doc_id, CAST(unnest(range(0, len(o))) AS INTEGER) AS chunk_index, unnest(o) AS text FROM (SELECT doc_id, list_concat(outs, CASE WHEN cur <> '' THEN [cur] ELSE [] END) AS o FROM r WHERE i = len(bs))
"""


@query("greedy_chunk_text", _GREEDY)
def _(spark, sf):
    d = P.table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return d.select("doc_id", F.posexplode(chunking.chunk_text("text")).alias("chunk_index", "text"))


@query("local_chunks", f"WITH {P.CHUNKS} SELECT chunk_id, title, text, tokens, list_aggregate(entities, 'string_agg', '|') AS entities FROM chunks")
def _(spark, sf):
    made = chunking.local_chunks(P.dealt(spark, sf))
    return made.select("chunk_id", "title", "text", "tokens", F.when(F.size("entities") > 0, _joined("entities")).alias("entities"))


_FIRST = "string_split(text, chr(10))[1]"
#: Lines of paged conversations with their sections; a recursion over them finds where chunks begin.
_PAGED = f"""
WITH RECURSIVE {P.CHAT},
en AS (SELECT doc_id, seq, page, {P.clean_heading("title")} AS title FROM co WHERE {P.clean_heading("title")} <> ''),
pg AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS page FROM chat),
ln AS (SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id ORDER BY page, j) AS k FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS j FROM pg) WHERE {P.trim("line")} <> ''),
li AS (SELECT ln.*, (SELECT max_by(title, seq) FROM en WHERE en.doc_id = ln.doc_id AND en.page <= ln.page) AS title, (SELECT count(*) FROM en WHERE en.doc_id = ln.doc_id AND en.page <= ln.page) AS nth FROM ln),
r AS (SELECT doc_id, k, page, title, length(line) + 1 AS size, 1 AS c FROM li WHERE k = 1
  UNION ALL SELECT doc_id, k, page, title, CASE WHEN ends THEN room ELSE size + room END, c + CASE WHEN ends THEN 1 ELSE 0 END
  FROM (SELECT li.doc_id, li.k, li.page, li.title, r.size, r.c, length(li.line) + 1 AS room, (li.page <> r.page AND li.title IS DISTINCT FROM r.title AND r.size >= {S.SECTION_LEAST}) OR r.size + length(li.line) + 1 > {S.CHUNK_HARD} AS ends
    FROM r JOIN li ON li.doc_id = r.doc_id AND li.k = r.k + 1)),
ck AS (SELECT doc_id, c, {P.trim("string_agg(line, chr(10) ORDER BY k)")} AS text, min_by(li.page, k) AS page, min_by(li.title, k) AS title, min_by(nth, k) AS nth FROM li JOIN r USING (doc_id, k) GROUP BY doc_id, c),
fr AS (SELECT *, (nth > coalesce(lag(nth) OVER (PARTITION BY doc_id ORDER BY c), 0) AND coalesce(title, '') <> '') OR {P.is_heading_line(_FIRST)} AS heading FROM ck),
ps AS (SELECT doc_id, c, page, title, heading, CASE WHEN length(text) <= {S.CHUNK_HARD} THEN [text] ELSE list_filter(list_transform(range(0, CAST(ceil(length(text) / {S.CHUNK_TARGET}) AS BIGINT)), lambda i: {P.trim(f"substr(text, i * {S.CHUNK_TARGET} + 1, {S.CHUNK_TARGET})")}), lambda x: x <> '') END AS ps FROM fr),
pu AS (SELECT doc_id, c, page, title, heading, unnest(ps) AS text, unnest(range(0, len(ps))) AS j FROM ps)
SELECT doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY c, j) - 1) AS chunk_id, coalesce(title, {P.title_from("text")}) AS title, CAST(page AS INTEGER) AS page, CAST(ceil(length(text) / 4) AS INTEGER) AS tokens, CASE WHEN heading THEN true END AS heading, title AS section, text FROM pu
"""


@query("section_chunks_pages", _PAGED)
def _(spark, sf):
    c = P.table(spark, sf, "conversations")
    entry = F.struct((1 + F.col("turn") % 3).cast("int").alias("level"), X.title_from("text").alias("title"), (F.col("turn") + 1).cast("int").alias("page"), F.lit(None).cast("array<string>").alias("path"))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("turn", x.alias("v")))), lambda r: r["v"])
    d = c.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(ordered(F.col("text")).alias("pages"), ordered(entry).alias("outline"))
    out = chunking.page_chunks(d.withColumn("outline", outline.normalize_outline("outline")))
    return out.select("chunk_id", "title", "page", "tokens", "heading", _joined("section_path", " / ").alias("section"), "text")


_OUTLINED = "'# Manual ' || doc_id || chr(10) || '1. Start here' || chr(10) || chr(96) || chr(96) || chr(96) || chr(10) || '# not a heading' || chr(10) || chr(96) || chr(96) || chr(96) || chr(10) || '1.2 ' || lang || ' part' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '##### Deep ' || source || chr(10) ELSE '' END || '第三章 ' || lang || chr(10) || 'plain text'"


@query(
    "outline_detect",
    f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 2 = 0 AS deep, lang, source FROM documents),
    e AS (SELECT doc_id, deep, unnest([{{'l': 1, 't': 'Manual ' || doc_id}}, {{'l': 1, 't': 'Start here'}}, {{'l': 2, 't': lang || ' part'}}] || CASE WHEN deep THEN [{{'l': 5, 't': 'Deep ' || source}}] ELSE [] END || [{{'l': 1, 't': lang}}], recursive := true),
      unnest(range(0, CASE WHEN deep THEN 5 ELSE 4 END)) AS seq FROM t)
    SELECT doc_id, CAST(seq AS INTEGER) AS seq, CAST(CASE WHEN deep THEN ceil(l / 5 * 4) ELSE l END AS INTEGER) AS level, t AS title FROM e""",
)
def _(spark, sf):
    text = F.concat(F.lit("# Manual "), F.col("doc_id").cast("string"), F.lit("\n1. Start here\n```\n# not a heading\n```\n1.2 "), F.col("lang"), F.lit(" part\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("##### Deep "), F.col("source"), F.lit("\n"))).otherwise(F.lit("")), F.lit("第三章 "), F.col("lang"), F.lit("\nplain text"))
    return outline.detect_outline(P.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text")))


@query("outline_shape", f"WITH {P.CHAT} SELECT doc_id, count(*) AS entries, max(level) AS max_level, count(*) FILTER (level = 1) AS chapters FROM co GROUP BY doc_id")
def _(spark, sf):
    return outline.outline_shape(P.chat_outline(spark, sf))


@query("outline_cut", f"WITH {P.CHAT}, l AS (SELECT doc_id, level, count(*) AS n FROM co GROUP BY ALL), r AS (SELECT doc_id, level, sum(n) OVER (PARTITION BY doc_id ORDER BY level) AS down, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM l) SELECT doc_id, max(level) AS cut, max(down) > 4 AS truncated FROM r WHERE down <= 4 OR k = 1 GROUP BY doc_id")
def _(spark, sf):
    return outline.outline_cut(P.chat_outline(spark, sf), 4)


_LINE = "string_split(text, chr(10))[1]"


@query(
    "heading_predicates",
    f"SELECT doc_id, {P.clean_heading(_LINE)} AS cleaned, {P.trim(_LINE)} <> '' AND length({P.trim(_LINE)}) <= 40 AND NOT regexp_matches({P.trim(_LINE)}, '[。．.；;，,：:！!？?、…]$') AS loose, {P.title_from('text')} AS title FROM documents",
)
def _(spark, sf):
    d = P.table(spark, sf, "documents")
    return d.select("doc_id", X.clean_heading(X.first_line("text")).alias("cleaned"), X.is_heading_title(X.first_line("text")).alias("loose"), X.title_from("text").alias("title"))


@query("text_labels", f"SELECT doc_id, {P.clip('text', 60)} AS clipped, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f', floor(n_chars / 1024 * 10 + 0.5) / 10) || ' KB' END AS size, replace(replace(replace(substr(text, 1, 80), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def _(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", X.clip("text", 60).alias("clipped"), X.format_bytes("n_chars").alias("size"), X.escape(X.cut(F.col("text"), 80)).alias("escaped"))


# ---- index and search ------------------------------------------------------------------------


@query("tokenize_terms", f"SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, CAST(len(list_distinct(ts)) AS BIGINT) AS n_distinct, md5(array_to_string(ts, ' ')) AS digest FROM (SELECT doc_id, {P.tokens('text')} AS ts FROM documents)")
def _(spark, sf):
    rows = spread(P.table(spark, sf, "documents")).select("doc_id", F.filter(X.tokenize("text"), lambda t: t != "").alias("ts"))
    return rows.select("doc_id", _long(F.size("ts")).alias("n"), _long(F.size(F.array_distinct("ts"))).alias("n_distinct"), F.md5(F.array_join("ts", " ")).alias("digest"))


@query("term_frequency", f"WITH {P.POSTINGS} SELECT chunk_id, term, tf FROM tf")
def _(spark, sf):
    return index.term_frequencies(P.to_index(P.chunks(spark, sf))).select("chunk_id", "term", "tf")


@query("document_frequency", f"WITH {P.POSTINGS} SELECT term, df FROM df")
def _(spark, sf):
    return P.stored_index(spark, sf).index().frequencies


@query("corpus_stats", f"WITH {P.POSTINGS} SELECT n, round(mean, 6) AS mean FROM st")
def _(spark, sf):
    lengths = P.stored_index(spark, sf).index().lengths
    return lengths.agg(F.count("*").alias("n"), _round(F.avg("length")).alias("mean"))


@query("field_weighted_tokens", f"WITH {P.POSTINGS} SELECT chunk_id, CAST(len(ts) AS BIGINT) AS n, md5(array_to_string(ts, ' ')) AS digest FROM tk")
def _(spark, sf):
    ts = F.filter(X.chunk_tokens("title", "summary", "text", "entities"), lambda t: t != "")
    return P.to_index(P.chunks(spark, sf)).select("chunk_id", ts.alias("ts")).select("chunk_id", _long(F.size("ts")).alias("n"), F.md5(F.array_join("ts", " ")).alias("digest"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_ALL = "SELECT item_id AS query_id, text FROM benchmark"
_RANK = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_index, chunk_id) AS rank FROM sc WHERE longest >= 2"
_TOP = "SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS relative FROM rk WHERE rank <= 5"


def _found(spark: SparkSession, sf: str, queries: DataFrame, docs: DataFrame | None = None, **options) -> DataFrame:
    made = P.stored_index(spark, sf)
    return search.best(made, search.query_terms(queries), docs=docs, **options)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", _round("score").alias("score"), _round("relative").alias("relative"))


@query("bm25_search_topk", f"WITH {P.bm25(_ALL + ' WHERE item_id = 0')}, rk AS ({_RANK}) {_TOP}")
def bm25_search_topk(spark, sf):
    return _shown(_found(spark, sf, _queries(spark, sf).filter("query_id = 0")))


@query("bm25_batch_queries", f"WITH {P.bm25(_ALL)}, rk AS ({_RANK}) {_TOP}")
def _(spark, sf):
    return _shown(_found(spark, sf, _queries(spark, sf)))


@query("bm25_tag_scope", f"WITH {P.bm25(_ALL, 'tf.doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lower(lang) IN (chr(102) || chr(114), chr(101) || chr(115)))')}, rk AS ({_RANK}) {_TOP}")
def _(spark, sf):
    return _shown(_found(spark, sf, _queries(spark, sf), search.tag_scope(P.docs(spark, sf), ["FR", " es "])))


_LONGEST = "(SELECT CAST(max_by(doc_id, (n_chars, doc_id)) AS VARCHAR) FROM documents)"


@query("bm25_doc_scope", f"WITH {P.bm25(_ALL, 'tf.doc_id = ' + _LONGEST)}, rk AS ({_RANK}) {_TOP}")
def _(spark, sf):
    longest = P.docs(spark, sf).orderBy(F.desc("size"), F.desc(F.col("doc_id").cast("long"))).limit(1)
    return _shown(_found(spark, sf, _queries(spark, sf), longest))


@query("bm25_min_score", f"WITH {P.bm25(_ALL)}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_index, chunk_id) AS rank FROM sc WHERE longest >= 2 AND score > 40) {_TOP}")
def _(spark, sf):
    return _shown(_found(spark, sf, _queries(spark, sf), least=40.0))


_SHORT = "SELECT 0 AS query_id, 'a i' AS text UNION ALL SELECT 1, 'a the'"


@query("bm25_short_term_veto", f"WITH {P.bm25(_SHORT)}, rk AS ({_RANK}) {_TOP}")
def _(spark, sf):
    return _shown(_found(spark, sf, spark.createDataFrame([(0, "a i"), (1, "a the")], "query_id int, text string")))


@query("matched_terms_first8", f"WITH {P.bm25(_ALL)}, rk AS ({_RANK}) SELECT query_id, chunk_id, array_to_string(list_slice(terms, 1, 8), '|') AS terms FROM rk WHERE rank <= 5")
def _(spark, sf):
    return _found(spark, sf, _queries(spark, sf)).select("query_id", "chunk_id", _joined("terms").alias("terms"))


@query("search_named_documents", "SELECT query_id, CAST(doc_id AS VARCHAR) AS doc_id FROM documents, (SELECT 0 AS query_id, 'DOC-7' AS q UNION ALL SELECT 1, '怎么 doc-1' UNION ALL SELECT 2, 'see doc-12.txt please') WHERE query_id <> 1 AND (contains('doc-' || doc_id || '.txt', lower(q)) OR contains(lower(q), 'doc-' || doc_id || '.txt'))")
def _(spark, sf):
    q = spark.createDataFrame([(0, "DOC-7"), (1, "怎么 doc-1"), (2, "see doc-12.txt please")], "query_id int, text string")
    none = spark.createDataFrame([], "query_id int, doc_id string")
    return search.named_documents(q, P.docs(spark, sf), none).select("query_id", "doc_id")


_AT = "coalesce(list_min(list_filter([instr(lower(text), 'the'), instr(lower(text), 'de')], lambda i: i > 0)) - 1, 0)"


@query(
    "snippet_window",
    f"""WITH a AS (SELECT doc_id, text, greatest(0, {_AT} - 233) AS s FROM documents), b AS (SELECT *, least(length(text), s + 700) AS e FROM a)
    SELECT doc_id, CASE WHEN length(text) <= 700 THEN text ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || {P.trim("substr(text, s + 1, e - s)")} || CASE WHEN e < length(text) THEN '…' ELSE '' END END AS snippet FROM b""",
)
def _(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", X.snippet("text", F.array(F.lit("the"), F.lit("de"))).alias("snippet"))


_SNIPPET = f"CASE WHEN length(text) <= 700 THEN text ELSE {P.trim('substr(text, 1, 700)')} || '…' END"
_HITS = f"WITH {P.bm25(_ALL)}, rk AS ({_RANK}), hi AS (SELECT *, {P.trim(_SNIPPET)} AS snip FROM (SELECT query_id, rank, title, chunks.text AS text, entities, 'doc-' || d.doc_id || '.txt' AS name, lower(lang) || '、' || lower(source) AS tags FROM rk JOIN chunks USING (chunk_id) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = chunks.doc_id WHERE rank <= 5))"


@query(
    "search_render_markdown",
    f"""{_HITS}, b AS (SELECT query_id, rank, concat_ws(chr(10), rank || '. **' || title || '**（' || name || CASE WHEN title <> '' THEN ' · ' || title ELSE '' END || '）', '   - 标签：' || tags, CASE WHEN len(entities) > 0 THEN '   - 实体：' || array_to_string(entities[1:6], '、') END,
    CASE WHEN snip <> '' THEN array_to_string(list_transform(string_split(snip, chr(10))[1:6], lambda x: '   > ' || x), chr(10)) END, '') AS block FROM hi)
    SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS markdown, count(*) AS hits FROM b GROUP BY query_id""",
)
def _(spark, sf):
    hits = search.search(P.stored_index(spark, sf), P.chunks(spark, sf), P.docs(spark, sf), _queries(spark, sf))
    return search.render_hits(hits)


@query(
    "ask_passages",
    f"""{_HITS} SELECT query_id, string_agg('[' || rank || '] 文档：' || name || '（标签：' || tags || '）' || chr(10) || '章节：' || title || chr(10) || '正文：' || {P.trim("text")}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS passages, count(*) AS n FROM hi GROUP BY query_id""",
)
def _(spark, sf):
    hits = search.search(P.stored_index(spark, sf), P.chunks(spark, sf), P.docs(spark, sf), _queries(spark, sf))
    return search.passages(hits)


@query("cited_passages", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([doc_id % 7, 3, doc_id % 12], lambda n: n >= 1 AND n <= 9))), ',') AS cited FROM documents")
def _(spark, sf):
    answer = F.concat(F.lit("So ["), (F.col("doc_id") % 7).cast("string"), F.lit("] and [3], also ["), (F.col("doc_id") % 12).cast("string"), F.lit("] [x]"))
    return P.table(spark, sf, "documents").select("doc_id", F.array_join(search.cited_passages(answer, F.lit(9)), ",").alias("cited"))


# ---- entities and graph ----------------------------------------------------------------------


@query("entities_top12", f"WITH {P.CHUNKS} SELECT chunk_id, list_aggregate(entities, 'string_agg', '|') AS entities FROM chunks")
def _(spark, sf):
    return P.chunks(spark, sf).select("chunk_id", F.when(F.size("entities") > 0, _joined("entities")).alias("entities"))


@query(
    "cross_links",
    f"""WITH {P.CHUNKS}, al AS (SELECT doc_id, flatten(list(entities ORDER BY chunk_index)) AS every FROM chunks GROUP BY doc_id), un AS (SELECT doc_id, {P.first_distinct("every")} AS known FROM al)
    SELECT chunk_id, coalesce(array_to_string(list_slice(list_filter(known, lambda e: e <> title AND contains(lower(text), lower(e)) AND NOT list_contains(entities, e)), 1, 8), '|'), '') AS links FROM chunks JOIN un USING (doc_id)""",
)
def _(spark, sf):
    return P.chunks(spark, sf).select("chunk_id", _joined("links").alias("links"))


@query("entity_rank", f"WITH {P.CHUNKS}, e AS (SELECT doc_id, unnest(entities) AS label FROM chunks), n AS (SELECT doc_id, label, count(*) AS count FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, label) AS rank FROM n) SELECT doc_id, CAST(rank AS INTEGER) AS rank, label, count FROM r WHERE rank <= 12")
def _(spark, sf):
    return entities.rank_entities(P.chunks(spark, sf)).select("doc_id", F.col("rank").cast("int").alias("rank"), "label", "count")


_MENTIONS = "mn AS (SELECT doc_id, chunk_id, chunk_index, unnest(entities) AS label, unnest(range(0, len(entities))) AS place FROM chunks)"
_NODES = f"""{_MENTIONS}, en AS (SELECT 'e:' || lower(label) AS id, min_by(label, (doc_id, chunk_index, place)) AS label, 'entity' AS kind, count(*) AS weight FROM mn GROUP BY lower(label)),
nd AS (SELECT * FROM en UNION ALL SELECT 'd:' || doc_id, 'doc-' || doc_id || '.txt', 'doc', (SELECT count(*) FROM chunks c WHERE c.doc_id = CAST(d.doc_id AS VARCHAR)) FROM documents d)"""
_EDGES = """ce AS (SELECT 'd:' || doc_id AS source, 'e:' || lower(label) AS target, 'contains' AS kind, count(*) AS weight FROM mn GROUP BY ALL),
dk AS (SELECT DISTINCT chunk_id, lower(label) AS k FROM mn),
re AS (SELECT 'e:' || a.k AS source, 'e:' || b.k AS target, 'relates' AS kind, count(*) AS weight FROM dk a JOIN dk b ON a.chunk_id = b.chunk_id AND a.k < b.k GROUP BY ALL),
ed AS (SELECT * FROM ce UNION ALL SELECT * FROM re)"""


@query("graph_nodes", f"WITH {P.CHUNKS}, {_NODES} SELECT id, label, kind, weight FROM nd")
def _(spark, sf):
    return graph.graph_nodes(P.docs(spark, sf), P.chunks(spark, sf)).select("id", "label", "kind", "weight")


@query("graph_edges_contains", f"WITH {P.CHUNKS}, {_MENTIONS}, {_EDGES} SELECT * FROM ce")
def _(spark, sf):
    return graph.contains_edges(P.chunks(spark, sf))


@query("graph_edges_relates", f"WITH {P.CHUNKS}, {_MENTIONS}, {_EDGES} SELECT * FROM re")
def _(spark, sf):
    return graph.relates_edges(P.chunks(spark, sf))


@query("graph_capped", f"WITH {P.CHUNKS}, {_NODES}, {_EDGES}, tn AS (SELECT * FROM nd ORDER BY weight DESC, id LIMIT 600) SELECT source, target, kind, weight FROM ed WHERE source IN (SELECT id FROM tn) AND target IN (SELECT id FROM tn) ORDER BY weight DESC, source, target, kind LIMIT 4000")
def _(spark, sf):
    c = P.chunks(spark, sf)
    return graph.capped(graph.graph_nodes(P.docs(spark, sf), c), graph.graph_edges(c))[1]


_DEGREE = """dg AS (SELECT id, sum(weight) AS degree FROM (SELECT source AS id, weight FROM ed UNION ALL SELECT target, weight FROM ed) GROUP BY id),
sl AS (SELECT id, label, CAST(coalesce(degree, 0) AS BIGINT) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, label, id) AS rank FROM en LEFT JOIN dg USING (id) QUALIFY rank <= 60)"""


@query("graph_degree_slice", f"WITH {P.CHUNKS}, {_NODES}, {_EDGES}, {_DEGREE} SELECT id, label, degree, CAST(rank AS INTEGER) AS rank, rank <= 40 AS labelled FROM sl")
def _(spark, sf):
    c = P.chunks(spark, sf)
    return graph.degree_slice(graph.graph_nodes(P.docs(spark, sf), c), graph.graph_edges(c)).withColumn("rank", F.col("rank").cast("int"))


_R0, _R1 = graph.ring(0)[0], graph.ring(1)[0]


@query(
    "graph_ring_layout",
    f"""WITH {P.CHUNKS}, {_NODES}, {_EDGES}, {_DEGREE}, n AS (SELECT count(*) AS n FROM sl),
    s AS (SELECT id, CASE WHEN rank <= 38 THEN 0 ELSE 1 END AS ring, CASE WHEN rank <= 38 THEN rank - 1 ELSE rank - 39 END AS slot, CASE WHEN rank <= 38 THEN least(38, n) ELSE n - 38 END AS taken, CASE WHEN rank <= 38 THEN {_R0}::DOUBLE ELSE {_R1}::DOUBLE END AS r FROM sl, n)
    SELECT id, CAST(ring AS INTEGER) AS ring, CAST(slot AS INTEGER) AS slot, round(500 + cos(slot / taken * 2 * pi() + CASE WHEN ring = 1 THEN pi() / taken ELSE 0 END - pi() / 2) * r, 6) AS x, round(360 + sin(slot / taken * 2 * pi() + CASE WHEN ring = 1 THEN pi() / taken ELSE 0 END - pi() / 2) * r, 6) AS y FROM s""",
)
def _(spark, sf):
    c = P.chunks(spark, sf)
    placed = graph.ring_layout(graph.degree_slice(graph.graph_nodes(P.docs(spark, sf), c), graph.graph_edges(c)))
    return placed.select("id", F.col("ring").cast("int").alias("ring"), F.col("slot").cast("int").alias("slot"), _round("x").alias("x"), _round("y").alias("y"))


@query("graph_neighbors", f"WITH {P.CHUNKS}, {_NODES}, {_EDGES}, nb AS (SELECT * FROM ed WHERE source = 'd:3' OR target = 'd:3') SELECT source AS id FROM nb UNION SELECT target FROM nb")
def _(spark, sf):
    return graph.neighbours(graph.graph_edges(P.chunks(spark, sf)), "d:3")


@query("graph_pairs_at_scale", "WITH x AS (SELECT DISTINCT l_orderkey AS o, l_partkey % 500 AS k FROM lineitem) SELECT a.k AS a, b.k AS b, count(*) AS weight FROM x a JOIN x b ON a.o = b.o AND a.k < b.k GROUP BY ALL")
def _(spark, sf):
    x = P.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_partkey") % 500).alias("k"))
    keys = x.groupBy("o").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return keys.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))


@query("entity_focus_docs", f"WITH {P.CHUNKS} SELECT DISTINCT doc_id FROM chunks WHERE list_contains(list_transform(entities, lambda e: lower(e)), 'la')")
def _(spark, sf):
    return listing.entity_docs(P.chunks(spark, sf), "LA")


# ---- lists, tags, counters -------------------------------------------------------------------

_TAGS = "tg AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest([lower(lang), lower(source)]) AS tag FROM documents)"


@query("tag_counts", f"WITH {_TAGS} SELECT tag, count(*) AS docs FROM tg GROUP BY tag")
def _(spark, sf):
    return listing.tag_counts(P.docs(spark, sf))


@query("docs_by_any_tag", f"WITH {_TAGS} SELECT DISTINCT doc_id FROM tg WHERE tag IN ('fr', 'src3')")
def _(spark, sf):
    return search.tag_scope(P.docs(spark, sf), ["FR", "src3", " "])


@query("unknown_tags", "SELECT tag FROM (SELECT unnest(['nope', 'zz'])  AS tag)")
def _(spark, sf):
    return listing.unknown_tags(P.docs(spark, sf), spark.createDataFrame([("EN",), ("Nope",), ("zz",), ("",)], "tag string"))


@query("normalize_tags", "SELECT doc_id, lower(lang) || '|' || 'two words' || '|' || substr(repeat('x', 40), 1, 32) AS tags FROM documents")
def _(spark, sf):
    raw = F.array(F.concat(F.lit("  "), F.upper("lang")), F.lit("Two   WORDS"), F.lit(""), F.col("lang"), F.lit("X" * 40))
    return P.table(spark, sf, "documents").select("doc_id", _joined(X.normalize_tags(raw)).alias("tags"))


@query("list_documents", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'doc-' || doc_id || '.txt' AS name FROM documents WHERE contains('doc-' || doc_id || '.txt', '1') AND lower(lang) = 'fr' ORDER BY CAST(doc_id AS VARCHAR) LIMIT 20")
def _(spark, sf):
    return listing.list_documents(P.docs(spark, sf), "1", "FR").select("doc_id", "name")


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with counts; chunks of labelled documents have a summary."""
    labelled = P.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("gist", F.lit("known"))
    c = P.chunks(spark, sf).join(labelled, "doc_id", "left").withColumn("summary", F.col("gist")).drop("gist")
    return listing.with_counts(P.docs(spark, sf), c)


_COUNTED = """cn AS (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, (SELECT count(*) FROM chunks c WHERE c.doc_id = CAST(d.doc_id AS VARCHAR)) AS chunk_count,
  (SELECT count(DISTINCT e) FROM (SELECT unnest(entities) AS e FROM chunks c WHERE c.doc_id = CAST(d.doc_id AS VARCHAR))) AS entity_count, d.doc_id IN (SELECT doc_id FROM labels) AS done FROM documents d)"""


@query("pending_counts", f"WITH {P.CHUNKS}, {_COUNTED} SELECT doc_id, chunk_count, entity_count, CASE WHEN done THEN chunk_count ELSE 0 END AS enhanced_chunks, CASE WHEN done THEN 0 ELSE chunk_count END AS pending FROM cn")
def _(spark, sf):
    return _counted(spark, sf).select("doc_id", "chunk_count", "entity_count", "enhanced_chunks", "pending")


@query("enhancement_filter", f"WITH {P.CHUNKS}, {_COUNTED} SELECT doc_id FROM cn WHERE done AND chunk_count > 0")
def _(spark, sf):
    return _counted(spark, sf).filter(listing.enhancement("enhanced")).select("doc_id")


@query("status_totals", f"WITH {P.CHUNKS}, {_COUNTED} SELECT count(*) AS docs, CAST(sum(chunk_count) AS BIGINT) AS chunks, CAST(sum(entity_count) AS BIGINT) AS entities, CAST(0 AS BIGINT) AS busy, count(*) FILTER (NOT done AND chunk_count > 0) AS pending_docs, count(*) FILTER (done AND chunk_count > 0) AS enhanced_docs FROM cn")
def _(spark, sf):
    return listing.status_totals(_counted(spark, sf))


@query("render_documents", f"WITH {P.CHUNKS}, {_COUNTED} SELECT doc_id, '- doc-' || doc_id || '.txt（100% · done｜id: ' || doc_id || ' · ' || chunk_count || ' 片段' || CASE WHEN done THEN ' · ' || chunk_count || ' 段已增强' ELSE '' END || ' · 标签：' || (SELECT lower(lang) || '、' || lower(source) FROM documents d WHERE CAST(d.doc_id AS VARCHAR) = cn.doc_id) || '）' AS line FROM cn WHERE chunk_count > 0")
def _(spark, sf):
    return listing.render_documents(listing.document_rows(_counted(spark, sf).filter("chunk_count > 0")))


@query("name_or_tag_search", "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE contains('doc-' || doc_id || '.txt', 'src1') OR contains(lower(lang), 'src1') OR contains(lower(source), 'src1')")
def _(spark, sf):
    return P.docs(spark, sf).filter(listing.name_or_tag("SRC1")).select("doc_id")


# ---- folders ---------------------------------------------------------------------------------


@query("folder_paths", f"WITH RECURSIVE {P.FOLDERS}, p AS (SELECT folder_id, name AS path, 1 AS depth FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.folder_id, p.path || ' / ' || f.name, p.depth + 1 FROM folders f JOIN p ON f.parent_id = p.folder_id) SELECT folder_id, path, depth FROM p")
def _(spark, sf):
    return folders.paths(P.folder_table(spark, sf))


@query("folder_subtree_docs", "SELECT CAST(c_custkey AS VARCHAR) AS doc_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def _(spark, sf):
    return folders.subtree_docs(P.folder_table(spark, sf), P.folder_docs(spark, sf), "r2").select("doc_id")


@query("folder_doc_counts", f"WITH {P.FOLDERS}, n AS (SELECT 'n' || c_nationkey AS folder_id, 'r' || n_regionkey AS parent_id, count(*) AS docs FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) SELECT folder_id, coalesce((SELECT docs FROM n WHERE n.folder_id = f.folder_id), 0) AS docs, CAST(coalesce((SELECT sum(docs) FROM n WHERE n.folder_id = f.folder_id OR n.parent_id = f.folder_id), 0) AS BIGINT) AS docs_below FROM folders f")
def _(spark, sf):
    return folders.doc_counts(P.folder_table(spark, sf), P.folder_docs(spark, sf))


@query("folder_height", f"WITH {P.FOLDERS} SELECT folder_id, CASE WHEN parent_id IS NULL AND folder_id IN (SELECT parent_id FROM folders) THEN 2 ELSE 1 END AS height FROM folders")
def _(spark, sf):
    return folders.heights(P.folder_table(spark, sf))


@query("folder_delete_hoist", "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_nationkey = 3 THEN (SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey = 3) ELSE 'n' || c_nationkey END AS folder_id FROM customer")
def _(spark, sf):
    return folders.delete(P.folder_table(spark, sf), P.folder_docs(spark, sf), "n3")[1]


@query("folder_display_order", f"WITH {P.FOLDERS}, k AS (SELECT f.folder_id, CASE WHEN p.name IS NULL THEN lower(f.name) || chr(1) || f.folder_id ELSE lower(p.name) || chr(1) || p.folder_id || chr(2) || lower(f.name) || chr(1) || f.folder_id END AS k, CASE WHEN p.name IS NULL THEN 1 ELSE 2 END AS depth FROM folders f LEFT JOIN folders p ON f.parent_id = p.folder_id) SELECT folder_id, depth, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place FROM k")
def _(spark, sf):
    return folders.display_order(P.folder_table(spark, sf))


# ---- sections, reading, exports --------------------------------------------------------------


@query("section_islands", f"WITH {P.CHAT} SELECT chunk_id, CAST(sum(CASE WHEN heading OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS INTEGER) AS section_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k FROM chat)")
def _(spark, sf):
    return outline.group_sections(P.chat_chunks(spark, sf)).select("chunk_id", "section_no")


_BLOCKS = f"""bl0 AS (SELECT *, CASE WHEN lag(title) OVER (PARTITION BY doc_id ORDER BY chunk_index) IS DISTINCT FROM title THEN 1 ELSE 0 END AS new FROM chat),
bl1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS block_no FROM bl0),
bl AS (SELECT doc_id, block_no, any_value(title) AS heading, min_by(page, chunk_index) AS page, string_agg({P.trim("text")}, chr(10) ORDER BY chunk_index) AS text FROM bl1 GROUP BY ALL)"""


@query("read_page_blocks", f"WITH {P.CHAT}, {_BLOCKS} SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, heading, page, text FROM bl")
def _(spark, sf):
    return reading.blocks(P.chat_chunks(spark, sf)).withColumn("block_no", _long("block_no"))


@query(
    "read_document_page",
    f"""WITH {P.CHAT.replace("FROM conversations)", "FROM conversations), tot AS (SELECT doc_id, count(*) AS total FROM chat GROUP BY doc_id)", 1)}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS nth FROM chat),
    bl0 AS (SELECT *, CASE WHEN lag(title) OVER (PARTITION BY doc_id ORDER BY chunk_index) IS DISTINCT FROM title THEN 1 ELSE 0 END AS new FROM n WHERE nth > 3 AND nth <= 6),
    bl1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS block_no FROM bl0),
    bl AS (SELECT doc_id, block_no, any_value(title) AS heading, min_by(page, chunk_index) AS page, string_agg({P.trim("text")}, chr(10) ORDER BY chunk_index) AS text FROM bl1 GROUP BY ALL),
    c AS (SELECT doc_id, string_agg('## ' || heading || '（第 ' || page || ' 页）' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY block_no) AS content FROM bl GROUP BY doc_id)
    SELECT doc_id, total, 6 < total AS has_more, CASE WHEN length(content) > 12000 THEN {P.trim_end("substr(content, 1, 12000)")} || chr(10) || '…' ELSE content END AS content, length(content) > 12000 AS truncated FROM c JOIN tot USING (doc_id)""",
)
def _(spark, sf):
    return reading.read_pages(P.chat_chunks(spark, sf), 2, 3).select("doc_id", "total", "has_more", "content", "truncated")


@query("asof_outline_assignment", f"WITH {P.CHAT}, anchors AS (SELECT doc_id, seq, page FROM co WHERE seq % 2 = 1) SELECT chat.doc_id, chat.chunk_index, CAST(a.seq AS INTEGER) AS node_no FROM chat ASOF JOIN anchors a ON chat.doc_id = a.doc_id AND chat.page >= a.page")
def _(spark, sf):
    nodes = P.chat_outline(spark, sf).filter("seq % 2 = 1").select("doc_id", F.col("seq").alias("node_no"), "page")
    return outline.assign_by_page(P.chat_chunks(spark, sf), nodes)


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[{P.WS}]+', '', 'g')"


@query(
    "title_match_ranges",
    f"""WITH RECURSIVE {P.CHAT}, xs AS (SELECT doc_id, list({_bare("text")} ORDER BY chunk_index) AS xs, list(chunk_index ORDER BY chunk_index) AS ks FROM chat GROUP BY doc_id),
    ts AS (SELECT doc_id, list({_bare("substr(title, 1, 20)")} ORDER BY seq) AS ts, list(seq ORDER BY seq) AS ns FROM co WHERE seq % 2 = 0 GROUP BY doc_id),
    r AS (SELECT doc_id, xs, ks, ts, ns, 0 AS i, 0 AS pos, CAST(NULL AS BIGINT) AS hit FROM xs JOIN ts USING (doc_id)
      UNION ALL SELECT doc_id, xs, ks, ts, ns, i + 1, CASE WHEN h > 0 THEN h ELSE pos END, h FROM (SELECT *, CASE WHEN length(ts[i + 1]) >= 2 THEN list_position(list_transform(xs, lambda x, j: j > pos AND contains(x, ts[i + 1])), true) END AS h FROM r WHERE i < len(ts))),
    st AS (SELECT doc_id, ks, ns[i] AS node_no, hit, coalesce(lead(hit) OVER (PARTITION BY doc_id ORDER BY hit), len(xs) + 1) AS nxt FROM r WHERE i > 0 AND hit > 0)
    SELECT doc_id, unnest(ks[hit:nxt - 1]) AS chunk_index, node_no FROM st""",
)
def _(spark, sf):
    nodes = P.chat_outline(spark, sf).filter("seq % 2 = 0").select("doc_id", F.col("seq").alias("node_no"), F.substring("title", 1, 20).alias("title"))
    return outline.assign_by_title(P.chat_chunks(spark, sf), nodes)


@query("section_parent_stack", f"WITH {P.CHAT} SELECT a.doc_id, a.seq AS node_no, a.level, max(b.seq) AS parent_no FROM co a LEFT JOIN co b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY ALL")
def _(spark, sf):
    return outline.nest(P.chat_outline(spark, sf).select("doc_id", F.col("seq").alias("node_no"), "level"))


@query(
    "section_fold_below_cut",
    f"""WITH {P.CHAT}, n AS (SELECT doc_id, seq, title, level <= 2 AS fits, sum(CASE WHEN level <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS nth FROM co WHERE doc_id IN (SELECT doc_id FROM co GROUP BY doc_id HAVING count(*) FILTER (level <= 2) <= 6 AND count(*) > 6))
    SELECT doc_id, CAST(nth - 1 AS INTEGER) AS node_no, count(*) AS folded FROM n WHERE NOT fits AND nth > 0 GROUP BY ALL""",
)
def _(spark, sf):
    o = P.chat_outline(spark, sf)
    n = o.groupBy("doc_id").agg(F.count_if(F.col("level") <= 2).alias("two"), F.count("*").alias("all")).filter("two <= 6 and all > 6")
    picked = outline.picked_entries(o.join(n, "doc_id", "left_semi"), 6)
    return picked.filter("not is_node and node_no is not null").groupBy("doc_id", "node_no").agg(F.count("*").alias("folded"))


@query(
    "section_numbering",
    f"""WITH RECURSIVE {P.CHAT}, p AS (SELECT a.doc_id, a.seq, max(b.seq) AS parent FROM co a LEFT JOIN co b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY seq) AS k FROM p),
    r AS (SELECT doc_id, seq, CAST(k AS VARCHAR) AS number, 1 AS depth FROM k WHERE parent IS NULL UNION ALL SELECT k.doc_id, k.seq, r.number || '.' || k.k, depth + 1 FROM k JOIN r ON k.doc_id = r.doc_id AND k.parent = r.seq)
    SELECT doc_id, seq AS node_no, number, depth FROM r""",
)
def _(spark, sf):
    nodes = outline.nest(P.chat_outline(spark, sf).select("doc_id", F.col("seq").alias("node_no"), "level"))
    return outline.numbering(nodes).select("doc_id", "node_no", "number", "depth")


def _chat_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with an outline that starts at their third turn."""
    entry = F.struct("level", "title", "page", F.lit(None).cast("array<string>").alias("path"))
    o = P.chat_outline(spark, sf).filter("seq >= 2").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("e")))), lambda x: x["e"]).alias("outline"))
    d = P.chat_outline(spark, sf).select("doc_id").distinct().join(o, "doc_id", "left")
    none = F.lit(None).cast("string")
    return d.select("doc_id", F.concat(F.lit("chat "), "doc_id").alias("name"), F.concat(F.lit("chat "), "doc_id", F.lit(".txt")).alias("original_name"), F.lit("text/plain").alias("mime"), F.lit(2048).cast("long").alias("size"), none.alias("warning"), none.alias("summary"), "outline", F.lit("text-headings").alias("outline_source"))


@query("orphan_chunks", f"WITH {P.CHAT} SELECT doc_id, chunk_index FROM chat WHERE page < 3 AND doc_id IN (SELECT doc_id FROM co WHERE seq >= 2)")
def _(spark, sf):
    owned = outline.section_tree(_chat_docs(spark, sf), P.chat_chunks(spark, sf))[1]
    return owned.filter("node_no = -1").select("doc_id", "chunk_index")


@query("section_owners", f"WITH {P.CHAT} SELECT doc_id, chunk_index, CASE WHEN page < 3 THEN -1 ELSE page - 3 END AS node_no FROM chat WHERE doc_id IN (SELECT doc_id FROM co WHERE seq >= 2)")
def _(spark, sf):
    d = _chat_docs(spark, sf)
    return outline.section_tree(d, P.chat_chunks(spark, sf))[1].join(d.filter("outline is not null"), "doc_id", "left_semi").select("doc_id", "chunk_index", "node_no")


_BODY = f"CASE WHEN {P.trim('title')} <> '' AND {P.trim(f"regexp_replace({P.trim(_FIRST)}, '^#{{1,6}}[{P.WS}]*', '')")} = {P.trim('title')} THEN {P.trim("CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END")} ELSE {P.trim('text')} END"
_NUMBERED = f"regexp_matches(title, '^[{P.WS}]*(?:[0-9]+(?:\\.[0-9]+)*|第[{P.WS}]*[一二三四五六七八九十百零〇0-9]{{1,4}}[{P.WS}]*[章节篇])')"
_SENTENCE = "^[^。．.!！?？;；]{8,}[。．.!！?？]"
_ORPHANS = "未归入目录的内容"
#: Sections of conversations with an outline from their third turn on, of the others by heading turns, with what they own.
_SECTIONS = f"""
WITH RECURSIVE {P.CHAT},
ol AS (SELECT doc_id, seq - 2 AS node_no, level, {P.clean_heading("title")} AS title FROM co WHERE seq >= 2),
bo AS (SELECT *, {_BODY} AS body, doc_id IN (SELECT doc_id FROM ol) AS outlined, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) = 1 OR heading AS opens FROM chat),
ow AS (SELECT doc_id, chunk_index, page, body, title, CASE WHEN NOT outlined THEN sec WHEN page >= 3 THEN page - 3 ELSE -1 END AS node_no FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS sec FROM bo) WHERE NOT outlined OR page >= 3 OR body <> ''),
no AS (SELECT a.doc_id, a.node_no, max(b.node_no) AS parent, a.title, true AS outlined FROM ol a LEFT JOIN ol b ON a.doc_id = b.doc_id AND b.node_no < a.node_no AND b.level < a.level GROUP BY a.doc_id, a.node_no, a.title
  UNION ALL SELECT DISTINCT doc_id, -1, CAST(NULL AS INTEGER), '{_ORPHANS}', true FROM ow WHERE node_no = -1
  UNION ALL SELECT doc_id, node_no, CAST(NULL AS INTEGER), {P.clip("min_by(title, chunk_index)", 60)}, false FROM ow WHERE doc_id NOT IN (SELECT doc_id FROM ol) GROUP BY doc_id, node_no),
kn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY node_no) AS k FROM no),
nu AS (SELECT doc_id, node_no, CAST(k AS VARCHAR) AS number, 1 AS depth FROM kn WHERE parent IS NULL UNION ALL SELECT kn.doc_id, kn.node_no, nu.number || '.' || kn.k, depth + 1 FROM kn JOIN nu ON kn.doc_id = nu.doc_id AND kn.parent = nu.node_no),
fa AS (SELECT doc_id, node_no, count(*) AS own, min(page) AS low, max(page) AS high, min_by(body, chunk_index) AS first_body, string_agg(body, chr(10) || chr(10) ORDER BY chunk_index) FILTER (body <> '') AS bodies FROM ow GROUP BY doc_id, node_no),
ki AS (SELECT doc_id, parent AS node_no, count(*) AS kids, string_agg(title, '、' ORDER BY node_no) AS children FROM no WHERE parent IS NOT NULL GROUP BY doc_id, parent),
se AS (SELECT no.doc_id, title, outlined, number, repeat('#', least(6, depth + 1)) || ' ' AS mark, CASE WHEN {_NUMBERED} THEN title ELSE number || '. ' || title END AS label, coalesce(own, 0) AS own,
  CASE WHEN low IS NULL THEN '' WHEN low = high THEN '第 ' || low || ' 页' ELSE '第 ' || low || '-' || high || ' 页' END AS pages, first_body, bodies, kids, children, list_transform(string_split(number, '.'), lambda x: CAST(x AS INTEGER)) AS ord
  FROM no JOIN nu USING (doc_id, node_no) LEFT JOIN fa USING (doc_id, node_no) LEFT JOIN ki USING (doc_id, node_no))"""


@query(
    "markdown_export",
    f"""{_SECTIONS},
    bl AS (SELECT doc_id, ord, concat_ws(chr(10), mark || label, '', '> ' || CASE WHEN pages <> '' THEN pages || ' · ' ELSE '' END || own || ' 个片段', '', CASE WHEN kids >= 2 THEN '**子节：** ' || children || chr(10) END, bodies || chr(10), '') AS block FROM se)
    SELECT doc_id, '# chat ' || doc_id || chr(10) || chr(10) || '> 来源文件：`chat ' || doc_id || '.txt` · 类型 `text/plain` · 大小 2.0 KB' || chr(10) || '> 片段 **' || n || '** · 实体 **0** · LLM 增强：**未开启**' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY ord) || chr(10) || '---' || chr(10) AS markdown
    FROM bl JOIN (SELECT doc_id, count(*) AS n FROM chat GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, n""",
)
def _(spark, sf):
    return export.markdown(_chat_docs(spark, sf), P.chat_chunks(spark, sf))


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_EXCERPT = P.clip(f"(CASE WHEN regexp_matches({P.trim(P.squeeze('first_body'))}, '{_SENTENCE}') THEN regexp_extract({P.trim(P.squeeze('first_body'))}, '{_SENTENCE}', 0) ELSE first_body END)", 120)


@query(
    "mindmap_export",
    f"""{_SECTIONS},
    bl AS (SELECT doc_id, ord, outlined, concat_ws(chr(10), mark || {_escaped("label")}, '', CASE WHEN pages <> '' THEN '- 位置：' || pages || ' · ' || own || ' 个片段' END, CASE WHEN {_EXCERPT} <> '' THEN '- 摘录：' || {_escaped(_EXCERPT)} END, '') AS block FROM se),
    oc AS (SELECT doc_id, count(*) AS entries, max(level) AS deepest FROM ol GROUP BY doc_id)
    SELECT doc_id, '# chat ' || doc_id || chr(10) || chr(10) || '## 概览' || chr(10) || chr(10) || '- 文件：chat ' || doc_id || '.txt' || chr(10) || '- 规模：2.0 KB · ' || n || ' 个片段 · 0 个实体' || chr(10) || '- 结构：' ||
      CASE WHEN entries IS NULL THEN '未找到文档目录，已按标题行归并 ' || count(*) || ' 个章节' ELSE '文本标题 · ' || entries || ' 个条目 · 最深 ' || deepest || ' 级' END || chr(10) || '- LLM 增强：未开启' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY ord) AS mindmap
    FROM bl JOIN (SELECT doc_id, count(*) AS n FROM chat GROUP BY doc_id) USING (doc_id) LEFT JOIN oc USING (doc_id) GROUP BY doc_id, n, entries, deepest""",
)
def _(spark, sf):
    return export.mind_map(_chat_docs(spark, sf), P.chat_chunks(spark, sf))


@query("mindmap_paint_depth", f"WITH {P.CHAT}, n AS (SELECT doc_id, level AS depth, count(*) AS n FROM co GROUP BY ALL), p AS (SELECT doc_id, depth, sum(n) OVER w + coalesce(lead(n) OVER w, 0) AS painted FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY depth)) SELECT doc_id, coalesce(max(depth) FILTER (painted <= 5), 1) AS keep FROM p GROUP BY doc_id")
def _(spark, sf):
    n = P.chat_outline(spark, sf).groupBy("doc_id", F.col("level").alias("depth")).agg(F.count("*").alias("n"))
    return export.paint_depth(n, 5)


_FURNITURE = "fl AS (SELECT source AS doc_id, doc_id AS page_no, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(
    "page_furniture_lines",
    f"""WITH {_FURNITURE}, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) AS n, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS k FROM fl),
    s AS (SELECT doc_id, line, count(DISTINCT page_no) AS pages FROM k WHERE (k <= 3 OR k > n - 3) AND line <> '' AND length(line) <= 80 GROUP BY ALL), p AS (SELECT doc_id, count(DISTINCT page_no) AS n_pages FROM fl GROUP BY doc_id)
    SELECT doc_id, line, pages FROM s JOIN p USING (doc_id) WHERE n_pages >= 20 AND pages >= greatest(5, ceil(n_pages * 0.25))""",
)
def _(spark, sf):
    lines = P.table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return outline.furniture_lines(lines)


# ---- enrichment and changes ------------------------------------------------------------------


@query(
    "enrich_targets_round_robin",
    f"""WITH {P.CHAT}, s AS (SELECT *, sum(CASE WHEN heading OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS sec FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k FROM chat)),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY chunk_index) AS turn FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, sec) AS pick FROM t) SELECT chunk_id FROM p WHERE pick <= 3""",
)
def _(spark, sf):
    return enrich.select_targets(P.chat_chunks(spark, sf), 3).select("chunk_id")


@query("enrich_merge_entities", f"WITH {P.CHUNKS}, m AS (SELECT chunk_id, list_concat(entities, ['New', title, '']) AS every FROM chunks), n AS (SELECT chunk_id, list_filter(list_transform(every, lambda x: {P.trim('x')}), lambda x: x <> '') AS every FROM m) SELECT chunk_id, array_to_string(list_slice({P.first_distinct('every')}, 1, 12), '|') AS entities FROM n")
def _(spark, sf):
    more = F.array(F.lit("New"), F.col("title"), F.lit(""))
    return P.chunks(spark, sf).select("chunk_id", _joined(enrich.merged(F.col("entities"), more, S.CHUNK_ENTITIES)).alias("entities"))


@query(
    "enrich_stand_in",
    f"""WITH {P.CHAT}, s AS (SELECT *, sum(CASE WHEN heading OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS sec FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k FROM chat)),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY chunk_index) AS turn FROM s), p AS (SELECT chunk_id, {P.trim(P.squeeze("substr(text, 1, 4000)"))} AS flat, row_number() OVER (PARTITION BY doc_id ORDER BY turn, sec) AS pick FROM t),
    g AS (SELECT chunk_id, pick, CASE WHEN regexp_matches(flat, '^[^。．.!！?？;；]{{8,}}[。．.!！?？]') THEN regexp_extract(flat, '^[^。．.!！?？;；]{{8,}}[。．.!！?？]', 0) ELSE flat END AS f FROM p)
    SELECT chunk_id, CASE WHEN pick <= 2 AND f <> '' THEN CASE WHEN length(f) <= 90 THEN f ELSE {P.trim_end("substr(f, 1, 89)")} || '…' END END AS summary FROM g""",
)
def _(spark, sf):
    return enrich.enrich(P.chat_chunks(spark, sf), enrich.FirstSentence(), 2).select("chunk_id", "summary")


@query("section_coverage", f"WITH {P.CHAT}, s AS (SELECT *, sum(CASE WHEN heading OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS sec FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k FROM chat)), c AS (SELECT doc_id, sec, count(*) AS n, sum(CASE WHEN chunk_index % 3 = 0 THEN 1 ELSE 0 END) AS e FROM s GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(e) AS BIGINT) AS enhanced, count(*) AS sections, count(*) FILTER (e > 0) AS covered, CAST(least(98, round(100 * sum(e) / sum(n))) AS INTEGER) AS progress FROM c GROUP BY doc_id")
def _(spark, sf):
    c = P.chat_chunks(spark, sf).withColumn("summary", F.when(F.col("chunk_index") % 3 == 0, F.lit("gist")))
    return enrich.coverage(c)


@query("document_summary", f"WITH {P.CHAT} SELECT doc_id, array_to_string(list_slice(list('gist ' || chunk_index ORDER BY chunk_index), 1, 5), ' ') AS summary FROM chat GROUP BY doc_id")
def _(spark, sf):
    c = P.chat_chunks(spark, sf).withColumn("summary", F.concat(F.lit("gist "), F.col("chunk_index").cast("string")))
    return enrich.document_summary(c)


@query(
    "summary_carryover",
    f"""WITH {P.PIECES}, old AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN text ELSE substr(text, 11, 400) END AS text, 's' || chunk_index AS s FROM pieces),
    x AS (SELECT n.doc_id, n.chunk_index, max_by(o.s, (CASE WHEN o.text = n.text THEN 1 ELSE 0 END, length(o.text), CASE WHEN o.text = n.text THEN o.chunk_index ELSE -o.chunk_index END)) FILTER (o.text = n.text OR length(o.text) >= 300) AS s FROM pieces n JOIN old o ON n.doc_id = o.doc_id AND contains(n.text, o.text) GROUP BY ALL)
    SELECT p.doc_id || '#' || p.chunk_index AS chunk_id, x.s AS summary FROM pieces p LEFT JOIN x USING (doc_id, chunk_index)""",
)
def _(spark, sf):
    rows = P.dealt(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(chunking.chunk_text("text")).alias("chunk_index", "text"))
    rows = stored(rows).withColumn("chunk_id", F.concat("doc_id", F.lit("#"), F.col("chunk_index").cast("string"))).withColumn("summary", F.lit(None).cast("string"))
    old = rows.withColumn("text", F.when(F.col("chunk_index") % 2 == 0, F.col("text")).otherwise(F.substring("text", 11, 400))).withColumn("summary", F.concat(F.lit("s"), F.col("chunk_index").cast("string")))
    return store.carry_summaries(rows, old).select("chunk_id", "summary")


@query("chunk_patch_merge", f"WITH {P.CHAT} SELECT chunk_id, CASE WHEN chunk_index = 1 THEN 'patched' ELSE text END AS text FROM chat UNION ALL SELECT 'new#0', 'added'")
def _(spark, sf):
    c = P.chat_chunks(spark, sf).select("doc_id", "chunk_id", "chunk_index", "text")
    patch = c.filter("chunk_index = 1").withColumn("text", F.lit("patched")).unionByName(spark.createDataFrame([("new", "new#0", 0, "added")], c.schema))
    return store.merge_chunks(c, patch).select("chunk_id", "text")


@query("set_chunks_replace", f"WITH {P.CHAT} SELECT chunk_id, text FROM chat WHERE doc_id <> '1' UNION ALL SELECT '1#0', 'only'")
def _(spark, sf):
    c = P.chat_chunks(spark, sf).select("doc_id", "chunk_id", "chunk_index", "text")
    return store.set_chunks(c, spark.createDataFrame([("1", "1#0", 0, "only")], c.schema)).select("chunk_id", "text")


@query("doc_upsert", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 10 = 0 THEN 'renamed' ELSE 'doc-' || doc_id || '.txt' END AS name FROM documents UNION ALL SELECT 'x', 'renamed'")
def _(spark, sf):
    d = P.docs(spark, sf).select("doc_id", "name")
    new = d.filter(F.col("doc_id").cast("long") % 10 == 0).select("doc_id").unionByName(spark.createDataFrame([("x",), ("",), (None,)], "doc_id string")).withColumn("name", F.lit("renamed"))
    return store.upsert(d, new)


@query("doc_delete_cascade", f"WITH {P.PIECES} SELECT doc_id, count(*) AS n FROM pieces WHERE CAST(doc_id AS BIGINT) % 3 <> 0 GROUP BY doc_id")
def _(spark, sf):
    c = P.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(chunking.chunk_text("text")).alias("text"))
    d = P.docs(spark, sf)
    return store.delete_documents(d, c, d.filter(F.col("doc_id").cast("long") % 3 == 0))[1].groupBy("doc_id").agg(F.count("*").alias("n"))


# ---- lifecycle and streams -------------------------------------------------------------------


@query("lifecycle_latest_status", f"WITH {P.STATUS} SELECT doc_id, max_by(status, (ts, event_id)) AS status, max(ts) AS ts, count(*) AS events FROM se GROUP BY doc_id")
def _(spark, sf):
    return lifecycle.latest(P.status_events(spark, sf))


@query("lifecycle_transitions", f"WITH {P.STATUS} SELECT from_status, status AS to_status, count(*) AS n FROM (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS from_status FROM se) GROUP BY ALL")
def _(spark, sf):
    return lifecycle.transitions(P.status_events(spark, sf))


@query("resume_candidates", f"WITH {P.STATUS}, l AS (SELECT doc_id, max_by(status, (ts, event_id)) AS status FROM se GROUP BY doc_id) SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) IN (SELECT doc_id FROM documents) THEN 'enrich' ELSE 'parse' END AS phase FROM l WHERE status IN ('queued', 'extracting', 'enriching')")
def _(spark, sf):
    return lifecycle.resume_candidates(lifecycle.latest(P.status_events(spark, sf)), P.docs(spark, sf))


@query("stream_ingest_counts", "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def _(spark, sf):
    import uuid

    from tessera.streaming import ingest

    name = f"counts_{uuid.uuid4().hex[:8]}"
    path = f"{sf}/events.parquet"
    static = spark.read.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(path if spark.read.format("binaryFile").load(path).limit(2).count() > 1 else f"{sf}/events*.parquet")
    ingest.counted(stream, name, new_path(spark, name)).awaitTermination()
    return spark.table(name)


# ---- extensions: what the engine below gives beyond the reference -----------------------------


@query("ext_join_inner", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, sf):
    c, n = P.table(spark, sf, "customer"), P.table(spark, sf, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("ext_join_semi_anti", "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without FROM customer GROUP BY c_mktsegment")
def _(spark, sf):
    c, o = P.table(spark, sf, "customer"), P.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return c.join(o, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count_if("hit").alias("with_orders"), F.count_if(F.col("hit").isNull()).alias("without"))


@query("ext_rollup_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, sf):
    return P.table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ext_window_rank", "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3")
def _(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return P.table(spark, sf, "orders").withColumn("rank", F.rank().over(w)).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("ext_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def _(spark, sf):
    a, b = P.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), P.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ext_event_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    e = P.table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query("ext_event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, sf):
    e = P.table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("ext_approx_distinct")
def _(spark, sf):
    return P.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))
