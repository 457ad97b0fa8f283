"""What the training-data operators share: words, hashes, materialised tables, bounded lookups."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.storage import checkpointed, spread
from tessera.storage import stored as stored

#: A word is a run of anything but these six ASCII spaces; ``bytes.split()`` splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a lookup table that may be broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Bytes of rows without a fixed width that may be broadcast.
BROADCAST_BYTES = 16_000_000

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M2
        x = (x ^ (x >> U64(27))) * _M3
    return x ^ (x >> U64(31))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two arrays of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * _M1 + b)


_BYTE = mix(np.arange(256, dtype=U64) + U64(0x1234567))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
#: Bytes of text that are hashed together.
HASHED = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2 ** 64."""
    if len(_POWERS["up"]) <= n:
        size = 1 << max(n, HASHED + 1).bit_length()
        base = 0x9E3779B97F4A7C15
        for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
            step = np.full(size, x, U64)
            step[0] = 1
            _POWERS[name] = np.cumprod(step)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(rows: list[bytes | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, one after the other, and each text's number of words.

    A word's hash is the difference of two prefix sums of its bytes' random values times powers of an odd
    number, brought to the same power, so all words are hashed by a few array operations.
    """
    hashes, counts, part, held = [], [], [], 0
    for k, b in enumerate(rows):
        part.append(b or b"")
        held += len(part[-1]) + 1
        if held >= HASHED or k == len(rows) - 1:
            h, n = _hashed(part, lower)
            hashes.append(h), counts.append(n)
            part, held = [], 0
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.empty(0, U64), np.empty(0, np.int64))


def _hashed(part: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join([*part, b""]), np.uint8)
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * _M1)
    ends = np.cumsum([len(x) + 1 for x in part])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def by_text(hashes: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """The slice of each text."""
    ends = np.cumsum(counts).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        yield hashes[a:b]


class Lookup:
    """Places of 64-bit keys in a sorted array, by a table over their mixed leading bits."""

    def __init__(self, keys: np.ndarray):
        mixed = mix(keys.view(U64)) if len(keys) else np.empty(0, U64)
        self.order = np.argsort(mixed)
        self.mixed = mixed[self.order]
        self.shift = U64(64 - max(1, len(keys).bit_length() + 2))
        cells = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.int64)
        self.first = np.searchsorted((self.mixed >> self.shift).astype(np.int64), cells).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key in the given array, -1 if it is not there."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.mixed):
            return out
        m = mix(wanted.view(U64))
        at = self.first[(m >> self.shift).astype(np.int64)]
        top = len(self.mixed) - 1
        for k in range(self.most):
            x = np.minimum(at + k, top)
            hit = self.mixed[x] == m
            out[hit] = self.order[x[hit]]
        return out


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def parts(batches: Iterable[pa.RecordBatch], size: int = 2_000_000, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, to bound what a task holds."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            limit = (ends[at - 1] if at else 0) + size
            to = min(max(at + 1, int(np.searchsorted(ends, limit, side="right"))), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


#: Bytes of an Arrow batch that goes to Python, unless the session has a setting of its own; Spark's default is 64 MB.
BATCH_BYTES = 2_000_000
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Settings of the session that operators of several steps need.

    Batches for Python are bounded where they are made, unless the session has a bound of its own: a worker holds a
    batch several times over (Arrow, bytes, arrays). A step's shuffle files go when it ends, since what a later step
    needs of it is checkpointed or stored; otherwise they stay until the driver happens to collect its garbage.
    """
    if spark.conf.get(_BATCHES) == f"{1 << 26}b":
        spark.conf.set(_BATCHES, f"{BATCH_BYTES}b")
    spark.conf.set(_CLEANUP, "true")


def trim() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and what they keep counts as the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with small batches; a task's memory goes back to the system at its end."""
    prepare(df.sparkSession)

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(tidy, schema)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    return checkpointed(df)


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``rows`` rows, else as it is (joined by a shuffle).

    size, if rows have no fixed width, gives a row's bytes; their sum may be BROADCAST_BYTES at most.
    """
    if size is None:
        return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small
    n, width = small.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(small) if n <= rows and (width or 0) <= BROADCAST_BYTES else small


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table of the driver's; unlike one made from a list, no executor starts Python for it."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    cols = list(zip(*rows, strict=True)) or [[]] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow), schema=kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out to all cores if they are fewer tasks than that."""
    return spread(table(spark, sf_dir, "documents"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = f"__{stem}_{uuid.uuid4().hex[:8]}"
    return name


def with_arrow(df: DataFrame, column: str, kind: T.DataType, of: Callable[[pa.RecordBatch], pa.Array | list], arrow: pa.DataType, by: str, start: Callable[[], Callable] | None = None) -> DataFrame:
    """``df`` with one more column that ``of`` makes from Arrow batches; the other columns pass through unchanged.

    Batches hold a few MB of the column ``by``. start, if given, is called once in each task and returns ``of``.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(column, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start() if start else of
        for b in parts(batches, name=by):
            made = f(b)
            made = made if isinstance(made, pa.Array | pa.ChunkedArray) else pa.array(made, arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, column])

    return in_arrow(df, run, schema)

