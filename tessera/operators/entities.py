"""Entities over groups of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_entities(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",), most: int = 12) -> DataFrame:
    """keys, rank, label, count: each chunk counts once for an entity; ties go by the label's code points."""
    rows = chunks.select(*keys, F.explode(F.array_distinct("entities")).alias("label")).filter("label != ''")
    n = rows.groupBy(*keys, "label").agg(F.count("*").alias("count"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "label")
    return n.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def distinct_links(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",), most: int = 8) -> DataFrame:
    """keys, links: the first distinct links in the order of chunks."""
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "links"))), lambda x: x["links"]))
    return chunks.filter("links is not null").groupBy(*keys).agg(F.slice(F.array_distinct(every), 1, most).alias("links"))
