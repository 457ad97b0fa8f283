"""Byte-level BPE by the ranks of a given vocabulary; nothing is trained here.

A text is split by the tokenizer's pattern and each piece is merged by itself. Within a piece a segment tree
over byte positions stores the leftmost minimum of rank and position of the pair that starts there; a merge
takes the root's pair and performs point updates on the two live neighbours, each logarithmic in the length
of the piece, so a piece of any length costs n log n. Pieces seen before come from a bounded memory.

Null text counts as empty and gives no tokens; repeated rows are encoded alike; an empty table gives an
empty table; other columns pass through, and an input column named like an output column is replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import fresh, texts, with_arrow

#: Pieces remembered by a task.
REMEMBERED = 400_000
#: Longer texts are split piece by piece rather than into one list.
LONG_TEXT = 1 << 22
_AT, _BYTE, _NONE = 32, (1 << 32) - 1, 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a line holds the base64 of a token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the piece's own rank if it has one, else by merges.

    A leaf of the tree is the byte at which a pair of neighbouring tokens starts, and holds rank << 32 | byte, so its
    root has the leftmost pair of the least rank. All is in one function, as the calls would take most of the time.
    """
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(n - 2, 0).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << _AT | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (least := tree[1]) != _NONE:
        i = least & _BYTE
        j = after[i]
        k = after[j]
        after[i] = k
        # The pair at j is gone; the one at i, and the one before that ends in it, have other tokens now.
        points = [(i, _NONE)] if j >= n - 1 else [(j, _NONE), (i, _NONE)]
        if k < n:
            before[k] = i
            if (r := get(piece[i : after[k]])) is not None:
                points[-1] = (i, r << _AT | i)
        if (p := before[i]) >= 0:
            r = get(piece[p:k])
            points.append((p, _NONE if r is None else r << _AT | p))
        for x, key in points:
            x += size
            tree[x] = key
            x >>= 1
            while x:
                a, b = tree[2 * x], tree[2 * x + 1]
                if a > b:
                    a = b
                if tree[x] == a:
                    break
                tree[x] = a
                x >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder(dict):
    """Pieces to packed ids. Of what it remembers the older half goes when there is too much, but for what was used again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = REMEMBERED):
        super().__init__()
        self.ranks, self.split, self.room, self.old = ranks, regex.compile(pattern), room, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = struct.pack(f"<{len(ids := merge(piece.encode(), self.ranks))}I", *ids)
        if len(piece) <= 64:
            if 2 * len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        s = (text or b"").decode("utf-8", "replace")
        if len(s) <= LONG_TEXT:
            return b"".join(map(self.__getitem__, self.split.findall(s)))
        return b"".join(self._long(m[0] for m in self.split.finditer(s)))

    def _long(self, pieces: Iterator[str]) -> Iterable[bytes]:
        while some := list(islice(pieces, 100_000)):
            yield b"".join(map(self.__getitem__, some))


#: The encoder of the last vocabulary, kept by a Python worker from task to task.
_KEPT: dict[tuple, Encoder] = {}


def _encoding(ranks: dict[bytes, int], pattern: str, text: str) -> Callable[[pa.RecordBatch], list[bytes]]:
    name = (pattern, len(ranks), hash(frozenset(ranks.items())))
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Encoder(ranks, pattern)
    encode = _KEPT[name].encode
    return lambda batch: [encode(b) for b in texts(batch, text)]


def _decoding(ranks: dict[bytes, int], ids: str) -> Callable[[pa.RecordBatch], list[bytes | None]]:
    token = [b""] * (max(ranks.values(), default=-1) + 1)
    for b, r in ranks.items():
        token[r] = b
    of = token.__getitem__
    return lambda batch: [None if x is None else b"".join(map(of, np.frombuffer(x, "<u4").tolist())) for x in texts(batch, ids)]


def _both(ranks: dict[bytes, int], pattern: str, text: str) -> Callable[[pa.RecordBatch], pa.Array]:
    encoding, decoding = _encoding(ranks, pattern, text), _decoding(ranks, "ids")

    def of(batch: pa.RecordBatch) -> pa.Array:
        ids = pa.array(encoding(batch), pa.binary())
        return pa.StructArray.from_arrays([ids, pa.array(decoding(pa.RecordBatch.from_arrays([ids], names=["ids"])), pa.binary())], names=["token_ids", "decoded"])

    return of


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text as packed little-endian unsigned 32-bit integers."""
    docs = docs if into not in docs.columns else docs.drop(into)
    return with_arrow(docs, into, T.BinaryType(), None, pa.binary(), text, start=partial(_encoding, ranks, pattern, text))


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that each packed list of ids stands for (null: null)."""
    tokens = tokens if into not in tokens.columns else tokens.drop(into)
    return with_arrow(tokens, into, T.BinaryType(), None, pa.binary(), ids, start=partial(_decoding, ranks, ids))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with token_ids and decoded: ``encode`` and then ``decode`` of its ids, in one pass of Python."""
    docs = docs.drop("token_ids", "decoded")
    column = fresh(docs, "both")
    kind = T.StructType([T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    arrow = pa.struct([("token_ids", pa.binary()), ("decoded", pa.binary())])
    return with_arrow(docs, column, kind, None, arrow, text, start=partial(_both, ranks, pattern, text)).select(*docs.columns, f"{column}.token_ids", f"{column}.decoded")
