"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def _least(pairs: DataFrame, keep) -> DataFrame:
    """Each u's neighbours v get u's least neighbour, or u itself if that is less."""
    m = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(m, "u")
    return linked.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (longs). node, component (its least node) of every node that has an edge to another.

    Null ends and loops are left out; repeated edges count once; no edges give an empty table. Neighbours are
    never collected: minima are aggregated partially and joined back.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e)
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, F.col("v") > F.col("u")).filter(F.col("u") != F.col("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = materialize(small.filter(F.col("u") != F.col("v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
