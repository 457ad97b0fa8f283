"""Reading a document page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators.search import section_of


def blocks(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Consecutive chunks of one heading as one block: keys, block_no, heading, page (of the first), text."""
    order = Window.partitionBy(*keys).orderBy("chunk_index")
    rows = chunks.withColumn("heading_text", section_of())
    new = F.lag("heading_text").over(order).isNull() | (F.lag("heading_text").over(order) != F.col("heading_text"))
    rows = rows.withColumn("new", new.cast("int")).withColumn("block_no", F.sum("new").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", X.trim("text").alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy(*keys, "block_no").agg(F.first("heading_text").alias("heading"), F.min_by("page", "chunk_index").alias("page"), text.alias("text"))


def read_pages(chunks: DataFrame, page: int = 1, page_size: int = 8, doc_id: str | None = None) -> DataFrame:
    """One page of each document, or of one: doc_id, page, page_size, total, has_more, section_titles, content, truncated.

    A document without chunks on the page is left out.
    """
    page, page_size = max(1, page), max(1, min(40, page_size))
    rows = chunks if doc_id is None else chunks.filter(F.col("doc_id") == doc_id)
    whole = Window.partitionBy("doc_id")
    rows = rows.withColumn("nth", F.row_number().over(whole.orderBy("chunk_index"))).withColumn("total", F.count("*").over(whole))
    first = (page - 1) * page_size
    shown = rows.filter((F.col("nth") > first) & (F.col("nth") <= first + page_size))
    totals = shown.groupBy("doc_id").agg(F.first("total").alias("total"))
    where = F.when(F.col("page") > 0, F.concat(F.lit("（第 "), F.col("page").cast("string"), F.lit(" 页）"))).otherwise(F.lit(""))
    piece = F.concat(F.lit("## "), F.col("heading"), where, F.lit("\n\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", piece.alias("piece"), X.trim("heading").alias("h"))))
    made = blocks(shown).groupBy("doc_id").agg(ordered.alias("x"))
    titles = F.slice(F.array_distinct(F.filter(F.transform("x", lambda b: b["h"]), lambda h: h != "")), 1, 8)
    content = F.array_join(F.transform("x", lambda b: b["piece"]), "\n\n")
    out = made.join(totals, "doc_id").withColumn("content", content)
    long_ = F.length("content") > S.PAGE_CHARS
    cut = F.when(long_, F.concat(X.trim_end(X.cut(F.col("content"), S.PAGE_CHARS)), F.lit("\n…"))).otherwise(F.col("content"))
    return out.select("doc_id", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), "total", (F.lit(first + page_size) < F.col("total")).alias("has_more"), titles.alias("section_titles"), cut.alias("content"), long_.alias("truncated"))


def render_page(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id and the text of its page with a header; rows are the documents' list rows."""
    first = (F.col("page") - 1) * F.col("page_size") + 1
    last = F.least(F.col("total"), F.col("page") * F.col("page_size"))
    status = F.when(F.col("progress") < 100, F.concat(F.lit("（解析中 "), F.col("progress").cast("string"), F.lit("%，内容可能不完整）"))).otherwise(F.lit(""))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("文档："), F.col("name"), status),
        F.concat(F.lit("id: "), F.col("doc_id")),
        F.concat(F.lit("片段 "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(" / 共 "), F.col("total").cast("string")),
        F.when(F.size("tags") > 0, F.concat(F.lit("标签："), F.array_join("tags", "、"))),
        F.when(F.size("section_titles") > 0, F.concat(F.lit("本页涉及章节："), F.array_join("section_titles", " / "))),
    )
    tail = F.concat(F.when(F.col("truncated"), F.lit("\n（本页内容已截断，可用更小的 pageSize 精读）")).otherwise(F.lit("")), F.when(F.col("has_more"), F.concat(F.lit("\n\n（还有更多片段，可用 page: "), (F.col("page") + 1).cast("string"), F.lit(" 继续读取）"))).otherwise(F.lit("")))
    return pages.join(rows.select("doc_id", "name", "progress", "tags"), "doc_id").select("doc_id", F.concat(head, F.lit("\n\n"), "content", tail).alias("text"))


# Characters of a chunk that are shown at first.
DISPLAY_CAP = 3000


def display_text(text: Column | str) -> Column:
    """A chunk's text as it is shown before it is unfolded."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.length(t) > DISPLAY_CAP, F.concat(X.cut(t, DISPLAY_CAP), F.lit("…"))).otherwise(t)
