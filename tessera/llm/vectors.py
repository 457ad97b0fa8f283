"""Blocks of integer vectors, and the arithmetic that is exact on them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import in_arrow, small_table
from tessera.llm.topk import quantized

_LONG = 2**63 - 1
#: Whole numbers below this are exact as doubles.
_WHOLE = 1 << 53


def integer_vectors(table: DataFrame, width: int, embedding: str = "embedding", scale: int = 256, **carried: Column) -> DataFrame:
    """``carried`` columns and ``weights``: floor(scale * x) of each component of the vectors of exactly ``width`` components.

    Vectors that are null, of another width, or hold null or non-finite components are left out.
    """
    rows = table.select(*[c.alias(n) for n, c in carried.items()], quantized(F.col(f"`{embedding}`"), scale).alias("weights"))
    return rows.filter(F.size("weights") == width)


def regrouped(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of some batches as tables of ``size`` rows, the last one of fewer."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            take = min(size - n, b.num_rows - at)
            held.append(b.slice(at, take))
            n, at = n + take, at + take
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def matrix(table: pa.Table, width: int) -> np.ndarray:
    """The weights of a table as rows of 64-bit integers."""
    return table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def put(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes of 2, 4 or 8 that hold all of them; the first byte tells how many."""
    most = max(-int(x.min(initial=0)), int(x.max(initial=0)) + 1)
    kind = next(k for k in (2, 4, 8) if most <= 1 << 8 * k - 1)
    return bytes([kind]) + np.ascontiguousarray(x, f"<i{kind}").tobytes()


def get(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles if squared distances of their rows, doubled ones too, are whole doubles, else as Python integers."""
    most = max(max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in arrays)
    small = 16 * most * most * max(x.shape[-1] for x in arrays) < _WHOLE
    return [x.astype(np.float64 if small else object) for x in arrays]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances of the rows of x and y, which ``exact`` made."""
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]


def as_longs(x: np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit integers, clipped to their range."""
    return x.astype(np.int64) if x.dtype != object else np.array([min(int(v), _LONG) for v in x.ravel()], np.int64).reshape(x.shape)


def listed(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One row that holds the values of a column as an array."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def by_component(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums that tasks made, as rows of keys, ``n`` and an array ``sums``, added up: keys, pos, n, total."""
    rows = sums.select(*keys, "n", F.posexplode("sums").alias("pos", "x"))
    return rows.groupBy(*keys, "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("total"))


def small(rows: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, bounded by a parameter, to be broadcast."""
    return F.broadcast(small_table(rows.sparkSession, values, schema))


def packed(rows: DataFrame, width: int, size: int, also: list[str], more=None, fields: str = "") -> DataFrame:
    """Blocks of up to ``size`` vectors: the columns ``also`` as arrays, ``vectors`` packed, and what ``more`` makes of the matrix."""
    kept = [T.StructField(n, T.ArrayType(rows.schema[n].dataType)) for n in also]
    extra = T.StructType.fromDDL(fields).fields if fields else []
    schema = T.StructType([*kept, T.StructField("vectors", T.BinaryType()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in regrouped(batches, size):
            x = matrix(t, width)
            made = [pa.array([v], pa.binary()) for v in (put(x), *(more(x) if more else ()))]
            yield pa.RecordBatch.from_arrays([*(listed(t.column(n)) for n in also), *made], names=schema.names)

    return in_arrow(rows, run, schema)
