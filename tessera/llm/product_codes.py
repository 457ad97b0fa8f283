"""Product codes of vectors: codebooks by filtering Lloyd rounds over kd-trees, in exact integers.

Vectors are packed into blocks once, and each block holds for every part position the order of a kd-tree over its
parts: nodes split at the middle of their rows along their box's longest side, so a node is a range of that order. A
round is one pass over the blocks without a shuffle. A task gives every node its bounding box, and caches its sum and
count; then it goes down the trees level by level, with the entries that are still possible for each node. Of these the
one nearest to the box's middle rules out each other one to which no corner of the box is nearer. A node that is left
with one entry is assigned whole, by its cached sum and count; only the parts of leaves with several entries are
compared one by one. Equal distances go to the lower index throughout. Tasks send one row of sums for each entry, which
are added up by component on executors; the driver holds codebooks only.

Vectors that are null, of another width, or hold null or non-finite components are left out, as if their rows were not
there. Rows with a null id take part, but start no entry unless the ids do not suffice; repeated rows each count. Of
rows with equal ids the one of lesser components comes first. Components beyond a long are clipped to its range, and so
are errors and sums of them. Fewer vectors than entries make smaller codebooks; an empty table gives an empty one.
Columns besides id, vector and label are not looked at.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded, in_arrow, spread, stored
from tessera.llm.vectors import _LONG, as_longs, by_component, exact, get, integer_vectors, packed, put, squares

#: Vectors of a block, and parts of a leaf at most.
BLOCK, LEAF = 8192, 16
TOTAL = T.DecimalType(38, 0)


def depth(n: int, leaf: int = LEAF) -> int:
    """Levels below the root, so that leaves hold at most ``leaf`` rows."""
    return max(0, (-(-n // leaf) - 1).bit_length())


def _starts(n: int, level: int) -> np.ndarray:
    return (n * np.arange(1 << level, dtype=np.int64)) >> level


def tree_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in the order of a kd-tree, whose node j of level l holds those from n * j >> l up to n * (j + 1) >> l."""
    n = len(points)
    order = np.arange(n)
    for level in range(depth(n, leaf)):
        starts, p = _starts(n, level), points[order]
        side = np.argmax((np.maximum.reduceat(p, starts) - np.minimum.reduceat(p, starts)).astype(np.float64), axis=1)
        node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        order = order[np.lexsort((p[np.arange(n), side[node]].astype(np.float64), node))]
    return order


@dataclass
class Tree:
    """Parts in tree order; for each level, from the root down, boxes, sums and counts of its nodes."""

    points: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @staticmethod
    def over(points: np.ndarray, leaf: int = LEAF) -> Tree:
        levels = depth(len(points), leaf)
        starts = _starts(len(points), levels)
        made = []
        for f in (np.minimum, np.maximum, np.add):
            level = [f.reduceat(points, starts)]
            while len(level[0]) > 1:
                level.insert(0, f(level[0][::2], level[0][1::2]))
            made.append(level)
        return Tree(points, *made)

    def ranges(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        starts = _starts(len(self.points), level)
        return starts, np.append(starts[1:], len(self.points))


def filtered(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The entry of each part in tree order, each entry's sum and count, and how many parts were compared one by one."""
    n, k = len(tree.points), len(book)
    entry = np.zeros(n, np.int64)
    sums, counts = np.zeros(book.shape, tree.points.dtype), np.zeros(k, np.int64)
    node, alive, compared = np.zeros(1, np.int64), np.ones((1, k), bool), 0
    for level in range(len(tree.low)):
        low, high = tree.low[level][node], tree.high[level][node]
        middle = np.where(alive, squares(low + high, 2 * book), np.inf)
        star = np.argmin(middle, axis=1)
        best = book[star]
        corner = np.where(book[None] > best[:, None], high[:, None], low[:, None])
        gain = ((book[None] - corner) ** 2 - (best[:, None] - corner) ** 2).sum(2)
        alive &= ~((gain > 0) | ((gain == 0) & (np.arange(k)[None] > star[:, None])))
        whole = alive.sum(1) == 1
        starts, ends = tree.ranges(level)
        at, chosen = node[whole], star[whole]
        np.add.at(sums, chosen, tree.sums[level][at])
        np.add.at(counts, chosen, ends[at] - starts[at])
        for a, b, c in zip(starts[at].tolist(), ends[at].tolist(), chosen.tolist(), strict=True):
            entry[a:b] = c
        node, alive = node[~whole], alive[~whole]
        if not len(node):
            break
        if level < len(tree.low) - 1:
            node, alive = np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(alive, 2, axis=0)
            continue
        size = ends[node] - starts[node]
        rows = np.repeat(starts[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
        near = np.argmin(np.where(np.repeat(alive, size, axis=0), squares(tree.points[rows], book), np.inf), axis=1)
        entry[rows], compared = near, len(rows)
        np.add.at(sums, near, tree.points[rows])
        counts += np.bincount(near, minlength=k)
    return entry, sums, counts, compared


def _orders(x: np.ndarray, parts: int, leaf: int) -> tuple[bytes]:
    (y,) = exact(x)
    return (put(np.stack([tree_order(p, leaf) for p in np.split(y, parts, axis=1)])),)


def _trees(row: dict, width: int, parts: int, leaf: int, books: np.ndarray) -> Iterator[tuple[np.ndarray, Tree, np.ndarray]]:
    """Of each part position: the order, the tree, and the codebook in the tree's arithmetic."""
    x = get(row["vectors"]).reshape(-1, width)
    y, entries = exact(x, books)
    for p, order in enumerate(get(row["orders"]).reshape(parts, -1)):
        yield order, Tree.over(np.split(y, parts, axis=1)[p][order], leaf), entries[p]


def _round(blocks: DataFrame, books: np.ndarray, width: int, leaf: int) -> np.ndarray:
    """The codebooks after one round. The driver gets as many numbers as codebooks have."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, d), object), np.zeros((parts, k), np.int64)
        for b in batches:
            for row in b.to_pylist():
                for p, (_, tree, book) in enumerate(_trees(row, width, parts, leaf, books)):
                    _, s, c, _ = filtered(tree, book)
                    sums[p] += np.array([int(v) for v in s.ravel()], object).reshape(s.shape)
                    counts[p] += c
        at = np.argwhere(counts > 0)
        if len(at):
            total = [[decimal.Decimal(v) for v in sums[p, e]] for p, e in at]
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[at[:, 0], at[:, 1]]), pa.array(total, pa.list_(pa.decimal128(38, 0)))], names=["part", "entry", "n", "sums"])

    new = books.copy()
    for r in by_component(in_arrow(blocks.select("vectors", "orders"), run, f"part int, entry int, n long, sums array<{TOTAL.simpleString()}>"), "part", "entry").collect():
        new[r["part"], r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    return new


def _coded(blocks: DataFrame, books: np.ndarray, width: int, leaf: int) -> DataFrame:
    """id, label, code and error of each vector of the blocks."""
    parts = len(books)
    schema = T.StructType([*(T.StructField(c, blocks.schema[c].dataType.elementType) for c in ("id", "label")), *T.StructType.fromDDL("code string, error long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                codes, error = [], 0
                for order, tree, book in _trees({c: b.column(c)[r].as_py() for c in ("vectors", "orders")}, width, parts, leaf, books):
                    entry = np.empty(len(order), np.int64)
                    entry[order] = filtered(tree, book)[0]
                    points = np.empty_like(tree.points)
                    points[order] = tree.points
                    error = error + ((points - book[entry]) ** 2).sum(1)
                    codes.append(entry)
                code = [bytes(c).hex() for c in np.stack(codes, 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(r, 1).flatten() for c in ("id", "label")), pa.array(code), pa.array(as_longs(error))], names=schema.names)

    return in_arrow(blocks, run, schema)


def encode(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 64, id_: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256, block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """Each vector's id_, code (two hex digits a part), error, label and label_error; and the codebooks by part, entry, component.

    Codebooks start as the parts of the ``entries`` vectors (256 at most) of least id. Each round assigns every part to
    its codebook's nearest entry, ties to the lower index, and replaces each used entry by its parts' mean, rounded
    down; then parts are assigned once more. label_error is the error summed over all vectors of a label, nulls together.
    """
    if width % parts or not 0 < entries <= 256:
        raise ValueError("the width must be a multiple of the parts, and entries from 1 to 256")
    rows = integer_vectors(spread(table.select(id_, embedding, label)), width, embedding, scale, id=F.col(f"`{id_}`"), label=F.col(f"`{label}`"))
    first = np.array([r[0] for r in rows.orderBy(F.col("id").asc_nulls_last(), "weights").limit(entries).select("weights").collect()], np.int64).reshape(-1, parts, width // parts)
    books = np.ascontiguousarray(first.transpose(1, 0, 2))
    named = [F.col("id").alias(id_), "code", "error", F.col("label").alias(label)]
    if not len(first):
        return rows.limit(0).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).select(*named, F.col("error").alias("label_error")), books
    blocks = stored(packed(rows, width, block, ["id", "label"], lambda x: _orders(x, parts, leaf), "orders binary"))
    for _ in range(rounds):
        books = _round(blocks, books, width, leaf)
    found = stored(_coded(blocks, books, width, leaf))
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast(TOTAL)), F.lit(_LONG).cast(TOTAL)).cast("long").alias("label_error"))
    kind = found.schema["label"].dataType
    size = F.coalesce(F.length("of"), F.lit(0)) if isinstance(kind, T.StringType) else None
    return found.join(bounded(by_label, size=size), F.col("label").eqNullSafe(F.col("of"))).select(*named, "label_error"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal integers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
