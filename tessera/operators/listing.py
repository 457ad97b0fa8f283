"""Lists of documents, counters, and predicates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema as S


def with_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs with chunk_count, entity_count (distinct in the document), enhanced_chunks and pending."""
    has = F.coalesce("summary", F.lit("")) != ""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.count_if(has).alias("enhanced_chunks"))
    e = chunks.select("doc_id", F.explode("entities").alias("e")).groupBy("doc_id").agg(F.count_distinct("e").alias("entity_count"))
    rows = docs.join(n, "doc_id", "left").join(e, "doc_id", "left").fillna(0, ["chunk_count", "enhanced_chunks", "entity_count"])
    return rows.withColumn("pending", F.col("chunk_count") - F.col("enhanced_chunks"))


def document_rows(docs: DataFrame) -> DataFrame:
    """The nine columns that lists report; absent values are 0, '' or empty."""
    progress = F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.coalesce("progress", F.lit(0)))))
    return docs.select(
        "doc_id",
        "name",
        progress.cast("int").alias("progress"),
        "status",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("enhanced_chunks", F.lit(0)).alias("enhanced_chunks"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.size("outline"), F.lit(0)).alias("outline_entries") if "outline" in docs.columns else F.lit(0).alias("outline_entries"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )


def name_like(q: str | None) -> Column:
    return F.lit(True) if not (q or "").strip() else F.contains(F.lower("name"), F.lit(q.strip().lower()))


def has_tag(tag: str | None) -> Column:
    return F.lit(True) if not (tag or "").strip() else F.coalesce(F.array_contains("tags", tag.strip().lower()), F.lit(False))


def name_or_tag(q: str) -> Column:
    """The panel's search box: in the name or in any tag."""
    q = q.strip().lower()
    return F.contains(F.lower("name"), F.lit(q)) | F.coalesce(F.exists("tags", lambda t: F.contains(t, F.lit(q))), F.lit(False))


def enhancement(state: str) -> Column:
    """all, pending (some chunks are not enhanced) or enhanced (all are, and there are some)."""
    n, left = F.col("chunk_count"), F.col("chunk_count") - F.col("enhanced_chunks")
    return {"all": F.lit(True), "pending": left > 0, "enhanced": (n > 0) & (left == 0)}[state]


def list_documents(docs: DataFrame, name: str | None = None, tag: str | None = None, limit: int = 20) -> DataFrame:
    """The newest documents first, at most ``limit`` (1 to 100)."""
    order = [F.desc("uploaded_at"), F.asc("doc_id")] if "uploaded_at" in docs.columns else [F.asc("doc_id")]
    return docs.filter(name_like(name) & has_tag(tag)).orderBy(*order).limit(max(1, min(100, limit)))


def render_documents(rows: DataFrame) -> DataFrame:
    """doc_id and the line that lists it."""
    some = lambda n, text: F.when(F.col(n) > 0, F.format_string(text, F.col(n).cast("long")))
    bits = F.concat_ws(" · ", F.concat(F.lit("id: "), F.col("doc_id")), F.coalesce(some("chunk_count", "%d 片段"), F.lit("未解析")), some("enhanced_chunks", "%d 段已增强"), some("outline_entries", "目录 %d 条"), F.when(F.size("tags") > 0, F.concat(F.lit("标签："), F.array_join("tags", "、"))))
    return rows.select("doc_id", F.concat(F.lit("- "), F.col("name"), F.lit("（"), F.col("progress").cast("string"), F.lit("% · "), F.col("status"), F.lit("｜"), bits, F.lit("）")).alias("line"))


def tag_counts(docs: DataFrame) -> DataFrame:
    """tag, docs: most used first, then by name."""
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "tag")


def tag_suggestions(docs: DataFrame, selected: list[str], most: int = 24) -> DataFrame:
    """The catalogue with the selected tags first."""
    mine = F.col("tag").isin(selected) if selected else F.lit(False)
    return tag_counts(docs).withColumn("selected", mine).orderBy(F.desc("selected"), F.desc("docs"), "tag").limit(most)


def unknown_tags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted tags (tag) that no document carries."""
    return wanted.select(F.lower(F.trim("tag")).alias("tag")).filter("tag != ''").distinct().join(tag_counts(docs), "tag", "left_anti")


def status_totals(counted: DataFrame) -> DataFrame:
    """One row: documents, chunks, entities (summed over documents), busy, pending and enhanced documents."""
    busy = F.col("status").isin(*S.RESUMABLE)
    return counted.agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entities"),
        F.count_if(busy).alias("busy"),
        F.count_if(F.col("pending") > 0).alias("pending_docs"),
        F.count_if((F.col("chunk_count") > 0) & (F.col("pending") == 0)).alias("enhanced_docs"),
    )


def entity_docs(chunks: DataFrame, entity: str) -> DataFrame:
    """The documents that mention an entity, in any case of letters."""
    return chunks.filter(F.exists("entities", lambda e: F.lower(e) == entity.lower())).select("doc_id").distinct()


# Labels of the states a document is in.
STATUS_LABELS = {"queued": "排队中", "extracting": "提取中", "parsing": "解析中", "enriching": "增强中", "indexing": "建库中", "extracted": "待增强", "done": "已完成", "error": "失败", "cancelled": "已停止"}


def status_label(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    out = s
    for k, v in STATUS_LABELS.items():
        out = F.when(s == k, F.lit(v)).otherwise(out)
    return out


# How an outline was found, and what stands in place of one.
OUTLINE_KINDS = {"pdf-bookmarks": "PDF 目录（书签）", "markdown-headings": "Markdown 标题", "text-headings": "文本标题"}
NO_OUTLINE = "未找到文档目录，已按标题行归并"


def outline_label(outline: Column | str, source: Column | str) -> Column:
    """How a document's structure was found, with the number of its entries and their deepest level."""
    o, s = (F.col(x) if isinstance(x, str) else x for x in (outline, source))
    kind = F.lit("文档目录")
    for k, v in OUTLINE_KINDS.items():
        kind = F.when(s == k, F.lit(v)).otherwise(kind)
    deepest = F.array_max(F.transform(o, lambda e: e["level"]))
    depth = F.when(deepest > 0, F.concat(F.lit(" · 最深 "), deepest.cast("string"), F.lit(" 级"))).otherwise(F.lit(""))
    return F.when(F.size(o) > 0, F.concat(F.lit("结构："), kind, F.lit(" · "), F.size(o).cast("string"), F.lit(" 条"), depth)).otherwise(F.lit(NO_OUTLINE))


def with_graph_size(totals: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals with how many nodes and edges the graph has."""
    return totals.withColumns({"graph_nodes": F.lit(nodes.count()), "graph_edges": F.lit(edges.count())})
