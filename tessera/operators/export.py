"""Documents as Markdown and as mind-map outlines, from their section trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import outline as O
from tessera.operators.entities import distinct_links, rank_entities
from tessera.storage import checkpointed

# Labels of this module's documents, here and below.
SOURCES = {"pdf-bookmarks": "PDF 目录（书签）", "markdown-headings": "Markdown 标题", "text-headings": "文本标题"}


def sections(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The unwrapped tree with numbers and depths, and the chunks' sections. Chunks without a section come first."""
    nodes, owned = O.unwrap_title(docs, *O.section_tree(docs, chunks))
    return checkpointed(O.numbering(nodes)), owned


def subtree_chunks(nodes: DataFrame, owned: DataFrame) -> DataFrame:
    """doc_id, node_no, chunk_index of each section's whole subtree: a section's number is a prefix of those below."""
    own = owned.join(nodes.select("doc_id", "node_no", "number"), ["doc_id", "node_no"])
    parts = F.split("number", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    above = own.select("doc_id", "chunk_index", F.explode(ups).alias("number"))
    return above.join(nodes.select("doc_id", "node_no", "number"), ["doc_id", "number"]).select("doc_id", "node_no", "chunk_index")


def page_range(low: Column, high: Column) -> Column:
    one = F.concat(F.lit("第 "), low.cast("string"), F.lit(" 页"))
    return F.when(low.isNull(), F.lit("")).when(low == high, one).otherwise(F.concat(F.lit("第 "), low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" 页")))


def section_facts(nodes: DataFrame, owned: DataFrame, chunks: DataFrame, links: int = 8) -> DataFrame:
    """Each section with own (chunks), pages, summary, excerpt, entities, links, children and bodies."""
    keys = ["doc_id", "node_no"]
    mine = owned.join(chunks, ["doc_id", "chunk_index"])
    all_ = subtree_chunks(nodes, owned).join(chunks, ["doc_id", "chunk_index"])
    has = F.coalesce("summary", F.lit("")) != ""
    paged = F.when(F.col("page") > 0, F.col("page"))
    body = X.body_of("title", "text")
    bodies = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", body.alias("b")))), lambda x: x["b"]), lambda b: b != "")
    own = mine.groupBy(*keys).agg(F.count("*").alias("own"), F.min(paged).alias("low"), F.max(paged).alias("high"), F.min_by("summary", F.when(has, F.col("chunk_index"))).alias("own_summary"), F.min_by(body, "chunk_index").alias("own_body"), bodies.alias("bodies"))
    whole = all_.groupBy(*keys).agg(F.min_by("summary", F.when(has, F.col("chunk_index"))).alias("all_summary"), F.min_by(body, "chunk_index").alias("all_body"))
    named = rank_entities(all_, tuple(keys), S.SECTION_ENTITIES).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("entities"))
    kids = nodes.filter("parent_no is not null").groupBy("doc_id", F.col("parent_no").alias("node_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("node_no").alias("k"), "title"))), lambda x: x["title"]).alias("children"))
    out = nodes
    for more in (own, whole, named, distinct_links(all_, tuple(keys), links), kids):
        out = out.join(more, keys, "left")
    none = F.array().cast("array<string>")
    return out.select(
        *nodes.columns,
        F.coalesce("own", F.lit(0)).alias("own"),
        page_range(F.col("low"), F.col("high")).alias("pages"),
        F.coalesce("own_summary", "all_summary").alias("summary"),
        X.first_sentence(F.coalesce("own_body", "all_body"), 120).alias("excerpt"),
        *[F.coalesce(c, none).alias(c) for c in ("entities", "links", "children", "bodies")],
    )


def _line(name: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(name), value))


def _folded() -> Column:
    more = F.when(F.col("folded_count") > F.size("folded"), F.concat(F.lit(" 等 "), F.col("folded_count").cast("string"), F.lit(" 节"))).otherwise(F.lit(""))
    return F.when(F.col("folded_count") > 0, F.concat(F.array_join("folded", "、"), more)).otherwise(F.lit(""))


def _order() -> Column:
    """A section's place in its document: by the numbers on the way to it."""
    return F.transform(F.split("number", r"\."), lambda x: x.cast("int"))


def _heading(label: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.col("depth") + 1)), F.lit(" "), label)


def _joined(rows: DataFrame, block: Column) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(_order().alias("k"), block.alias("b")))), lambda x: x["b"])
    return rows.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("sections"))


def _head_counts(chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.bool_or(F.coalesce("summary", F.lit("")) != "").alias("enhanced"))
    e = chunks.select("doc_id", F.explode("entities").alias("e")).groupBy("doc_id").agg(F.count_distinct("e").alias("entity_count"))
    return n.join(e, "doc_id", "left").fillna(0, ["entity_count"])


def markdown(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, markdown: the whole document by sections. Times of upload and export are left to the caller."""
    nodes, owned = sections(docs, chunks)
    facts = section_facts(nodes, owned, chunks)
    meta = F.concat_ws(" · ", F.when(F.col("pages") != "", F.col("pages")), F.concat(F.col("own").cast("string"), F.lit(" 个片段")))
    block = F.concat_ws(
        "\n",
        _heading(X.section_label("title", "number")),
        F.lit(""),
        F.concat(F.lit("> "), meta),
        F.lit(""),
        F.concat(_line("**小结：** ", F.coalesce("summary", F.lit(""))), F.lit("\n")),
        F.when(F.size("children") >= 2, F.concat(F.lit("**子节：** "), F.array_join("children", "、"), F.lit("\n"))),
        F.concat(_line("**更深子节：** ", _folded()), F.lit("\n")),
        F.when(F.size("bodies") > 0, F.concat(F.array_join("bodies", "\n\n"), F.lit("\n"))),
        _line("**实体：** ", F.array_join("entities", "、")),
        _line("**关联：** ", F.array_join("links", "、")),
        F.lit(""),
    )
    rows = docs.join(_head_counts(chunks), "doc_id").join(_joined(facts, block), "doc_id")
    on = F.when(F.col("enhanced"), "已开启").otherwise("未开启")
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), X.sanitize_base("name")),
        F.lit(""),
        F.concat(F.lit("> 来源文件：`"), F.coalesce("original_name", "name"), F.lit("` · 类型 `"), F.coalesce("mime", F.lit("unknown")), F.lit("` · 大小 "), X.format_bytes("size")),
        F.concat(F.lit("> 片段 **"), F.col("chunk_count").cast("string"), F.lit("** · 实体 **"), F.col("entity_count").cast("string"), F.lit("** · LLM 增强：**"), on, F.lit("**")),
        F.when(F.coalesce("warning", F.lit("")) != "", F.concat(F.lit("> ⚠ "), F.col("warning"))),
        F.lit(""),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("## 摘要\n\n"), F.col("summary"), F.lit("\n"))),
        F.lit("---"),
        F.lit(""),
    )
    return rows.select("doc_id", F.concat(head, F.lit("\n"), "sections", F.lit("\n---\n")).alias("markdown"))


def mind_map(docs: DataFrame, chunks: DataFrame, most: int = S.MAP_NODES) -> DataFrame:
    """doc_id, mindmap: the tree as headings with gists; sections beyond the cap are counted, not drawn."""
    nodes, owned = sections(docs, chunks)
    facts = section_facts(nodes, owned, chunks, links=5)
    facts = facts.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(_order())))
    gist = F.coalesce("summary", F.lit(""))
    place = F.when(F.col("pages") != "", F.concat(F.col("pages"), F.lit(" · "), F.col("own").cast("string"), F.lit(" 个片段"))).otherwise(F.lit(""))
    block = F.concat_ws(
        "\n",
        _heading(X.escape(X.section_label("title", "number"))),
        F.lit(""),
        _line("- 小结：", X.escape(X.clip(gist, 90))),
        _line("- 位置：", place),
        _line("- 实体：", X.escape(F.array_join("entities", "、"))),
        _line("- 关联：", X.escape(F.array_join("links", "、"))),
        _line("- 子节：", X.escape(_folded())),
        F.when(gist == "", _line("- 摘录：", X.escape("excerpt"))),
        F.lit(""),
    )
    drawn = _joined(facts.filter(F.col("nth") <= most), block)
    counts = facts.groupBy("doc_id").agg(F.count("*").alias("total"), F.bool_or("from_outline").alias("outlined"))
    top = rank_entities(chunks, ("doc_id",), S.MAP_ENTITIES)
    line = F.concat(F.lit("- "), X.escape(X.clip("label", 60)), F.lit("（"), F.col("count").cast("string"), F.lit("）"))
    top = top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("top"))
    rows = docs.join(_head_counts(chunks), "doc_id").join(drawn, "doc_id").join(counts, "doc_id").join(top, "doc_id", "left")
    levels = docs.select("doc_id", F.explode(O.normalize_outline("outline")).alias("e")).select("doc_id", F.col("e.level").alias("level"))
    rows = rows.join(O.outline_cut(levels).select("doc_id", "truncated"), "doc_id", "left")
    shape = O.normalize_outline("outline")
    label = F.lit("文档目录")
    for k, v in SOURCES.items():
        label = F.when(F.col("outline_source") == k, F.lit(v)).otherwise(label)
    deepest = F.array_max(F.transform(shape, lambda e: e["level"]))
    structure = F.when(F.size(shape) > 0, F.concat(label, F.lit(" · "), F.size(shape).cast("string"), F.lit(" 个条目 · 最深 "), deepest.cast("string"), F.lit(" 级"))).otherwise(F.concat(F.lit("未找到文档目录，已按标题行归并 "), F.col("total").cast("string"), F.lit(" 个章节")))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), X.escape(X.sanitize_base("name"))),
        F.lit(""),
        F.lit("## 概览"),
        F.lit(""),
        F.concat(F.lit("- 文件："), X.escape(X.clip(F.coalesce("original_name", "name"), 70))),
        F.concat(F.lit("- 规模："), X.format_bytes("size"), F.lit(" · "), F.col("chunk_count").cast("string"), F.lit(" 个片段 · "), F.col("entity_count").cast("string"), F.lit(" 个实体")),
        F.concat(F.lit("- 结构："), structure),
        F.when(F.col("outlined") & F.col("truncated"), F.lit(f"- 提示：目录条目过多，已展开前 {S.MAP_NODES} 个章节")),
        F.concat(F.lit("- LLM 增强："), F.when(F.col("enhanced"), "已开启").otherwise("未开启")),
        F.lit(""),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("## 摘要\n\n- "), X.escape(X.clip("summary", 300)), F.lit("\n"))),
    )
    left = F.when(F.col("total") > most, F.concat(F.lit("\n## 其余 "), (F.col("total") - most).cast("string"), F.lit(" 个章节已省略\n\n- 完整内容见导出的 Markdown 文档\n"))).otherwise(F.lit(""))
    tail = F.when(F.col("top").isNotNull(), F.concat(F.lit("\n## 关键实体\n\n"), F.col("top"), F.lit("\n"))).otherwise(F.lit(""))
    return rows.select("doc_id", F.concat(head, F.lit("\n"), "sections", left, tail).alias("mindmap"))


def paint_depth(per_depth: DataFrame, budget: int = 60) -> DataFrame:
    """per_depth: doc_id, depth (from 1), n -> doc_id, keep: the deepest level whose painted rows fit, 1 at least.

    Keeping a level paints its rows, those above, and the next level's as folded rows.
    """
    order = Window.partitionBy("doc_id").orderBy("depth")
    painted = F.sum("n").over(order) + F.coalesce(F.lead("n").over(order), F.lit(0))
    return per_depth.withColumn("painted", painted).groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("painted") <= budget, F.col("depth"))), F.lit(1)).alias("keep"))


def fold_below(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """nodes with fold: 1 on those just below the kept depth."""
    return nodes.join(keep, "doc_id").withColumn("fold", F.when(F.col("depth") == F.col("keep") + 1, F.lit(1))).drop("keep")
