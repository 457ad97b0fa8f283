"""The graph of documents and entities, its caps, and the slice of it that is drawn."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.storage import checkpointed


def mentions(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, place, label, key (the lower-case label) of each entity of each chunk."""
    return chunks.select("doc_id", "chunk_id", "chunk_index", F.posexplode("entities").alias("place", "label")).withColumn("key", F.lower("label"))


def entity_nodes(chunks: DataFrame) -> DataFrame:
    first = F.min_by("label", F.struct("doc_id", "chunk_index", "place"))
    rows = mentions(chunks).groupBy("key").agg(F.count("*").alias("weight"), first.alias("label"))
    return rows.select(F.concat(F.lit("e:"), F.col("key")).alias("id"), "label", F.lit("entity").alias("kind"), "weight", F.lit(None).cast("string").alias("doc_id"))


def graph_nodes(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, label, kind, weight, doc_id. A document weighs its chunks, an entity its mentions."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = docs.select("doc_id", "name").join(n, "doc_id", "left")
    nodes = rows.select(F.concat(F.lit("d:"), F.col("doc_id")).alias("id"), F.col("name").alias("label"), F.lit("doc").alias("kind"), F.coalesce("n", F.lit(0)).cast("long").alias("weight"), "doc_id")
    return nodes.unionByName(entity_nodes(chunks))


def contains_edges(chunks: DataFrame) -> DataFrame:
    """source, target, kind, weight: an edge for a document and an entity, weighing its mentions."""
    rows = mentions(chunks).groupBy("doc_id", "key").agg(F.count("*").alias("weight"))
    return rows.select(F.concat(F.lit("d:"), F.col("doc_id")).alias("source"), F.concat(F.lit("e:"), F.col("key")).alias("target"), F.lit("contains").alias("kind"), "weight")


def raw_contains_edges(chunks: DataFrame) -> DataFrame:
    """One edge of weight 1 for each mention."""
    return mentions(chunks).select(F.concat(F.lit("d:"), F.col("doc_id")).alias("source"), F.concat(F.lit("e:"), F.col("key")).alias("target"), F.lit("contains").alias("kind"), F.lit(1).cast("long").alias("weight"))


def relates_edges(chunks: DataFrame) -> DataFrame:
    """Pairs of entities with the number of chunks that mention both. A chunk has 12 entities at most, so 66 pairs."""
    pairs = lambda keys: F.flatten(F.transform(keys, lambda a, i: F.transform(F.slice(keys, i + 2, F.size(keys)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    keys = F.array_sort(F.array_distinct(F.transform("entities", F.lower)))
    rows = chunks.filter(F.size("entities") > 1).select(F.explode(X.bound(keys, pairs)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))
    return rows.select(F.concat(F.lit("e:"), F.col("a")).alias("source"), F.concat(F.lit("e:"), F.col("b")).alias("target"), F.lit("relates").alias("kind"), "weight")


def graph_edges(chunks: DataFrame) -> DataFrame:
    return contains_edges(chunks).unionByName(relates_edges(chunks))


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind", "weight")


def capped(nodes: DataFrame, edges: DataFrame, most_nodes: int = S.GRAPH_NODES, most_edges: int = S.GRAPH_EDGES) -> tuple[DataFrame, DataFrame]:
    """The heaviest nodes and the heaviest edges among them, if either is over its cap. Ties go to the smaller id."""
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    if nodes.limit(most_nodes + 1).count() <= most_nodes and edges.limit(most_edges + 1).count() <= most_edges:
        return nodes, edges
    top = nodes.orderBy(F.desc("weight"), "id").limit(most_nodes)
    return top, among(edges, F.broadcast(top)).orderBy(F.desc("weight"), "source", "target", "kind").limit(most_edges)


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: the weights of a node's edges at either end."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "weight")  # not a union, which makes the edges twice
    return ends.groupBy("id").agg(F.sum("weight").alias("degree"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """The node itself and what it shares an edge with."""
    near = edges.filter((F.col("source") == node) | (F.col("target") == node))
    return near.select(F.explode(F.array("source", "target")).alias("id")).distinct()


# The drawing's rings.
WIDTH, HEIGHT = 1000, 720
RINGS, GAP = 4, 26
EDGE_LIMIT, LABELS = 800, 40


def ring(k: int) -> tuple[float, int]:
    """Radius and capacity of a ring."""
    least, most = min(WIDTH, HEIGHT) * 0.22, min(WIDTH, HEIGHT) * 0.46
    radius = least + (most - least) * k / (RINGS - 1)
    return radius, max(6, math.floor(2 * math.pi * radius / GAP))


SLOTS = sum(ring(k)[1] for k in range(RINGS))
SLICES = (60, 150, SLOTS)


def degree_slice(nodes: DataFrame, edges: DataFrame, limit: int = SLICES[0], focus: str | None = None) -> DataFrame:
    """The best connected entities with rank and whether they are labelled; a focused one takes the last place."""
    order = Window.orderBy(F.desc("degree"), "label", "id")
    rows = nodes.filter("kind = 'entity'").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    wanted = F.lit(False) if focus is None else F.col("id") == "e:" + focus.lower()
    top = rows.orderBy(F.desc("degree"), "label", "id").limit(limit)
    if focus is not None:
        mine = rows.filter(wanted)
        head = rows.filter(~wanted).orderBy(F.desc("degree"), "label", "id").limit(limit - 1)
        inside = top.filter(wanted).limit(1).count() > 0 or mine.limit(1).count() == 0
        top = top if inside else head.unionByName(mine)
    return top.withColumn("rank", F.row_number().over(order)).withColumn("labelled", F.col("rank") <= LABELS).select("id", "label", "degree", "rank", "labelled")


def ring_layout(slice_: DataFrame) -> DataFrame:
    """id, ring, slot, x, y: rings are filled from the inside; odd ones are turned by half a slot."""
    total = slice_.count()
    at, ring_no, slot, taken, radius = 0, F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1), F.lit(0.0)
    rank = F.col("rank") - 1
    for k in range(RINGS):
        r, room = ring(k)
        inside = (rank >= at) & (rank < at + room)
        ring_no = F.when(inside, F.lit(k)).otherwise(ring_no)
        slot = F.when(inside, rank - at).otherwise(slot)
        taken = F.when(inside, F.lit(max(1, min(room, total - at)))).otherwise(taken)
        radius = F.when(inside, F.lit(r)).otherwise(radius)
        at += room
    turn = F.when(F.col("ring") % 2 == 1, math.pi / F.col("taken")).otherwise(0.0) - math.pi / 2
    angle = F.col("slot") / F.col("taken") * 2 * math.pi + turn
    rows = slice_.select("id", ring_no.alias("ring"), slot.alias("slot"), taken.alias("taken"), radius.alias("radius")).filter("ring is not null")
    return rows.select("id", "ring", "slot", (WIDTH / 2 + F.cos(angle) * F.col("radius")).alias("x"), (HEIGHT / 2 + F.sin(angle) * F.col("radius")).alias("y"))


def visible_edges(edges: DataFrame, placed: DataFrame, limit: int = SLICES[0]) -> DataFrame:
    """The heaviest edges among what is drawn; their number follows the slice."""
    cap = max(120, math.floor(EDGE_LIMIT * limit / SLOTS + 0.5))
    return among(edges, placed).orderBy(F.desc("weight"), "source", "target", "kind").limit(cap)
