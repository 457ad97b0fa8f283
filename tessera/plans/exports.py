"""Exports of documents whose chunks have summaries, entities and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import export
from tessera.plans import base as P
from tessera.plans.catalogue import _EXCERPT, _SECTIONS, _chat_docs, _escaped, query


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the turns have a summary; entities and links repeat between them."""
    k = F.col("chunk_index")
    return P.chat_chunks(spark, sf).withColumns(
        {
            "summary": F.when(k % 3 == 1, F.concat(F.lit("gist "), k.cast("string"), F.lit(" of <"), "title", F.lit(">"))),
            "entities": F.array(F.col("title"), F.concat(F.lit("T"), (k % 4).cast("string")), F.lit("Shared & more")),
            "links": F.array(F.concat(F.lit("L"), (k % 7).cast("string")), F.col("title"), F.concat(F.lit("M"), (k % 5).cast("string"))),
        }
    )


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _chat_docs(spark, sf).withColumns({"summary": F.concat(F.lit("About chat "), "doc_id"), "warning": F.lit("mind the gap")})


_RICH = f"""{_SECTIONS},
ri AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index % 3 = 1 THEN 'gist ' || chunk_index || ' of <' || title || '>' END AS summary, [title, 'T' || (chunk_index % 4), 'Shared & more'] AS ents, ['L' || (chunk_index % 7), title, 'M' || (chunk_index % 5)] AS links FROM chat),
al AS (SELECT up.doc_id, up.node_no, ri.chunk_index, summary, ents, links FROM nu up JOIN nu dn ON dn.doc_id = up.doc_id AND (dn.number = up.number OR starts_with(dn.number, up.number || '.')) JOIN ow ON ow.doc_id = dn.doc_id AND ow.node_no = dn.node_no JOIN ri ON ri.doc_id = ow.doc_id AND ri.chunk_index = ow.chunk_index),
sa AS (SELECT doc_id, node_no, min_by(summary, chunk_index) FILTER (summary IS NOT NULL) AS s FROM al GROUP BY ALL),
so AS (SELECT ow.doc_id, ow.node_no, min_by(summary, ow.chunk_index) FILTER (summary IS NOT NULL) AS s FROM ow JOIN ri ON ri.doc_id = ow.doc_id AND ri.chunk_index = ow.chunk_index GROUP BY ALL),
en AS (SELECT doc_id, node_no, string_agg(label, '、' ORDER BY n DESC, label) AS ents FROM (SELECT doc_id, node_no, label, count(*) AS n FROM (SELECT doc_id, node_no, unnest(list_distinct(ents)) AS label FROM al) GROUP BY doc_id, node_no, label QUALIFY row_number() OVER (PARTITION BY doc_id, node_no ORDER BY n DESC, label) <= 6) GROUP BY ALL),
lf AS (SELECT doc_id, node_no, flatten(list(links ORDER BY chunk_index)) AS fl FROM al GROUP BY ALL),
li AS (SELECT doc_id, node_no, {P.first_distinct("fl")} AS ls FROM lf),
rs AS (SELECT se.*, coalesce(so.s, sa.s, '') AS gist, coalesce(en.ents, '') AS ents, coalesce(array_to_string(ls[1:8], '、'), '') AS links8, coalesce(array_to_string(ls[1:5], '、'), '') AS links5
  FROM (SELECT se.*, nu.node_no FROM se JOIN nu ON nu.doc_id = se.doc_id AND nu.number = se.number) se LEFT JOIN sa USING (doc_id, node_no) LEFT JOIN so USING (doc_id, node_no) LEFT JOIN en USING (doc_id, node_no) LEFT JOIN li USING (doc_id, node_no)),
hd AS (SELECT doc_id, count(*) AS n, bool_or(summary IS NOT NULL) AS enhanced FROM ri GROUP BY doc_id),
te AS (SELECT doc_id, label, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(ents)) AS label FROM ri) GROUP BY ALL),
ec AS (SELECT doc_id, count(*) AS entities FROM te GROUP BY doc_id)"""
_ON = "CASE WHEN enhanced THEN '已开启' ELSE '未开启' END"


@query(
    "markdown_export_rich",
    f"""{_RICH},
    bl AS (SELECT doc_id, ord, concat_ws(chr(10), mark || label, '', '> ' || CASE WHEN pages <> '' THEN pages || ' · ' ELSE '' END || own || ' 个片段', '', CASE WHEN gist <> '' THEN '**小结：** ' || gist || chr(10) END, CASE WHEN kids >= 2 THEN '**子节：** ' || children || chr(10) END, bodies || chr(10),
      CASE WHEN ents <> '' THEN '**实体：** ' || ents END, CASE WHEN links8 <> '' THEN '**关联：** ' || links8 END, '') AS block FROM rs)
    SELECT doc_id, '# chat ' || doc_id || chr(10) || chr(10) || '> 来源文件：`chat ' || doc_id || '.txt` · 类型 `text/plain` · 大小 2.0 KB' || chr(10) || '> 片段 **' || n || '** · 实体 **' || entities || '** · LLM 增强：**' || {_ON} || '**' || chr(10) || '> ⚠ mind the gap' || chr(10) || chr(10) ||
      '## 摘要' || chr(10) || chr(10) || 'About chat ' || doc_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY ord) || chr(10) || '---' || chr(10) AS markdown
    FROM bl JOIN hd USING (doc_id) JOIN ec USING (doc_id) GROUP BY doc_id, n, entities, enhanced""",
)
def _(spark, sf):
    return export.markdown(_docs(spark, sf), _chunks(spark, sf))


_GIST = P.clip("gist", 90)


@query(
    "mindmap_export_rich",
    f"""{_RICH},
    bl AS (SELECT doc_id, ord, outlined, concat_ws(chr(10), mark || {_escaped("label")}, '', CASE WHEN gist <> '' THEN '- 小结：' || {_escaped(_GIST)} END, CASE WHEN pages <> '' THEN '- 位置：' || pages || ' · ' || own || ' 个片段' END, CASE WHEN ents <> '' THEN '- 实体：' || {_escaped("ents")} END,
      CASE WHEN links5 <> '' THEN '- 关联：' || {_escaped("links5")} END, CASE WHEN gist = '' AND {_EXCERPT} <> '' THEN '- 摘录：' || {_escaped(_EXCERPT)} END, '') AS block FROM rs),
    oc AS (SELECT doc_id, count(*) AS entries, max(level) AS deepest FROM ol GROUP BY doc_id),
    tl AS (SELECT doc_id, string_agg('- ' || {_escaped("label")} || '（' || n || '）', chr(10) ORDER BY n DESC, label) AS top FROM (SELECT * FROM te QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) <= 12) GROUP BY doc_id)
    SELECT doc_id, '# chat ' || doc_id || chr(10) || chr(10) || '## 概览' || chr(10) || chr(10) || '- 文件：chat ' || doc_id || '.txt' || chr(10) || '- 规模：2.0 KB · ' || n || ' 个片段 · ' || entities || ' 个实体' || chr(10) || '- 结构：' ||
      CASE WHEN entries IS NULL THEN '未找到文档目录，已按标题行归并 ' || count(*) || ' 个章节' ELSE '文本标题 · ' || entries || ' 个条目 · 最深 ' || deepest || ' 级' END || chr(10) || '- LLM 增强：' || {_ON} || chr(10) || chr(10) || '## 摘要' || chr(10) || chr(10) || '- About chat ' || doc_id || chr(10) || chr(10) ||
      string_agg(block, chr(10) ORDER BY ord) || chr(10) || '## 关键实体' || chr(10) || chr(10) || any_value(top) || chr(10) AS mindmap
    FROM bl JOIN hd USING (doc_id) JOIN ec USING (doc_id) JOIN tl USING (doc_id) LEFT JOIN oc USING (doc_id) GROUP BY doc_id, n, entities, enhanced, entries, deepest""",
)
def _(spark, sf):
    return export.mind_map(_docs(spark, sf), _chunks(spark, sf))
