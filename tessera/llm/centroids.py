"""Centroid clustering by Lloyd's rounds under Hamerly's bounds, in exact integers.

Vectors are packed into blocks once. A block carries the state of each of its vectors: the number of its centroid, one
upper bound of the distance to it, and one lower bound of the distance to the second nearest. A round is one pass over
the blocks without a shuffle: bounds are loosened by how far centroids moved; a vector whose upper bound stays below
its lower bound, or below half the way from its centroid to the next one, keeps its centroid unseen; the others first
get their true upper bound, and those still in doubt a full scan of all centroids in exact integers. Bounds are rounded
outwards and a vector is passed over only where they differ strictly, so that results are those of full scans, ties
included. Each task sends one row of sums for each centroid; these are added up by component on executors, and the
driver holds centroids only. Blocks with their new state are written to the shared folder in every round, so a lost
executor costs its tasks of one round.

Vectors that are null, of another width, or hold null or non-finite components are left out, as if their rows were not
there. Rows with a null id take part, but start no centroid unless the ids do not suffice; repeated rows each count.
Components beyond a long are clipped to its range, and so are distances and sums of them. Fewer vectors than centroids
make fewer centroids; an empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import in_arrow, spread, stored
from tessera.llm.vectors import _LONG, as_longs, by_component, exact, get, integer_vectors, packed, small, squares

#: Vectors of a block.
BLOCK = 8192
#: Bounds are loosened by so much of their size for rounding.
SLACK = 1e-12
TOTAL = T.DecimalType(38, 0)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid moved, rounded up."""
    a, b = exact(old, new)
    return np.sqrt(((a - b) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one, rounded down."""
    (c,) = exact(centroids)
    d = squares(c, c).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(np.maximum(d.min(1), 0)) / 2 * (1 - SLACK)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the least if several are, with an upper bound of its distance and a lower one of the next."""
    d = squares(*exact(x, centroids))
    near = np.argmin(d, axis=1)
    rows = np.arange(len(x))
    first = d[rows, near].astype(np.float64)
    d = d.astype(np.float64)
    d[rows, near] = np.inf
    return near, np.sqrt(first) * (1 + SLACK), np.sqrt(d.min(1)) * (1 - SLACK)


def squared(x: np.ndarray, centroids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The squared distance of each vector to its centroid."""
    a, c = exact(x, centroids)
    return ((a - c[near]) ** 2).sum(1)


def assign(x: np.ndarray, centroids: np.ndarray, state: tuple | None, drift: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One round of a block: nearest centroids, both bounds, and how many vectors were scanned in full."""
    if state is None:
        return *scan(x, centroids), len(x)
    near, upper, lower = (v.copy() for v in state)
    upper = (upper + drift[near]) * (1 + SLACK)
    most = np.argmax(drift)
    others = np.where(near == most, np.max(np.delete(drift, most), initial=0), drift[most])
    lower = np.where(np.isinf(lower), lower, lower - others - SLACK * (lower + others))
    safe = np.maximum(lower, gaps[near])
    at = np.flatnonzero(upper >= safe)
    upper[at] = np.sqrt(squared(x[at], centroids, near[at]).astype(np.float64)) * (1 + SLACK)
    at = at[upper[at] >= safe[at]]
    if len(at):
        near[at], upper[at], lower[at] = scan(x[at], centroids)
    return near, upper, lower, len(at)


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose salted ids hash least."""
    by = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return np.array([r[0] for r in rows.orderBy(by.asc_nulls_last(), "weights").limit(k).select("weights").collect()], np.int64)


def _decimals(x) -> list[decimal.Decimal]:
    return [decimal.Decimal(int(v)) for v in x]


def _round(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks with their state after an assignment, and each task's sums by centroid as rows without a block."""
    k, width = centroids.shape
    gaps = half_gaps(centroids)
    fields = T.StructType([*(f for f in blocks.schema.fields if f.name in ("id", "vectors")), *T.StructType.fromDDL("near binary, upper binary, lower binary, scanned long, cluster int, n long").fields, T.StructField("sums", T.ArrayType(TOTAL))])
    ids = pa.list_(pa.null())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, kind = np.zeros((k, width), object), np.zeros(k, np.int64), ids
        for b in batches:
            kind = b.column("id").type
            for r in range(b.num_rows):
                one = {c: b.column(c)[r].as_py() for c in b.schema.names if c != "id"}
                x = get(one["vectors"]).reshape(-1, width)
                state = (np.frombuffer(one["near"], "<i4"), np.frombuffer(one["upper"], "<f8"), np.frombuffer(one["lower"], "<f8")) if "near" in one else None
                near, upper, lower, scanned = assign(x, centroids, state, drift, gaps)
                (y,) = exact(x)
                for c in np.unique(near):
                    sums[c] += np.array([int(v) for v in y[near == c].sum(0)], object)
                counts += np.bincount(near, minlength=k)
                made = [near.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes()]
                row = [b.column("id").slice(r, 1), pa.array([one["vectors"]], pa.binary()), *(pa.array([m], pa.binary()) for m in made), pa.array([scanned], pa.int64())]
                row += [pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.decimal128(38, 0)))]
                yield pa.RecordBatch.from_arrays(row, names=fields.names)
        at = np.flatnonzero(counts)
        if len(at):
            none = [pa.nulls(len(at), t) for t in (kind, pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            full = [pa.array(at, pa.int32()), pa.array(counts[at]), pa.array([_decimals(sums[c]) for c in at], pa.list_(pa.decimal128(38, 0)))]
            yield pa.RecordBatch.from_arrays([*none, *full], names=fields.names)

    return stored(in_arrow(blocks, run, fields))


def _moved(round_: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's mean, rounded down; one without vectors stays. What the driver gets is as many numbers as centroids have."""
    new = centroids.copy()
    for r in by_component(round_.filter("cluster is not null"), "cluster").collect():
        new[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
    return new


def _rows(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and distance of each vector of the blocks."""
    width = centroids.shape[1]
    schema = T.StructType([T.StructField("id", blocks.schema["id"].dataType.elementType), *T.StructType.fromDDL("cluster int, distance long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                near = np.frombuffer(b.column("near")[r].as_py(), "<i4")
                far = squared(get(b.column("vectors")[r].as_py()).reshape(-1, width), centroids, near)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(r, 1).flatten(), pa.array(near), pa.array(as_longs(far))], names=schema.names)

    return in_arrow(blocks, run, schema)


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, id_: str = "vec_id", embedding: str = "embedding", scale: int = 256, salt: str = "2:", block: int = BLOCK) -> DataFrame:
    """id_, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector of ``width`` components.

    Centroids start as the k vectors with the least sha256 of salt and id (equal ones by their components). Each round
    assigns every vector to the nearest centroid, ties to the smaller number, and replaces every non-empty centroid by
    its vectors' mean, rounded down; then vectors are assigned once more.
    """
    rows = integer_vectors(spread(table.select(id_, embedding)), width, embedding, scale, id=F.col(f"`{id_}`"))
    schema = f"cluster int, cluster_inertia {TOTAL.simpleString()}, inertia {TOTAL.simpleString()}, centroid_sha256 string"
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):
        none = rows.select(F.col("id").alias(id_), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.withColumns({"cluster_inertia": F.col("distance"), "inertia": F.col("distance"), "centroid_sha256": F.lit("")}).limit(0)
    blocks, drift = stored(packed(rows, width, block, ["id"])), np.zeros(len(centroids))
    for r in range(rounds + 1):
        done = _round(blocks, centroids, drift)
        blocks = done.filter("near is not null").select("id", "vectors", "near", "upper", "lower")
        if r < rounds:
            new = _moved(done, centroids)
            centroids, drift = new, drifts(centroids, new)
    found = stored(_rows(blocks, centroids))
    inertia = {x["cluster"]: int(x["i"]) for x in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(TOTAL)).alias("i")).collect()}
    total = decimal.Decimal(min(_LONG, sum(inertia.values())))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = small(found, [(c, decimal.Decimal(min(_LONG, i)), total, digest[c]) for c, i in sorted(inertia.items())], schema)
    longs = [F.col(c).cast("long").alias(c) for c in ("cluster_inertia", "inertia")]
    return found.join(sums, "cluster").select(F.col("id").alias(id_), "cluster", "distance", *longs, "centroid_sha256")
