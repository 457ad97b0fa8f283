"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation over blocks.

Vectors are sparse rows over terms (dimensions) with integer weights. Queries are packed into blocks of rows by
term; a pass takes as many blocks as may be broadcast, and reads the candidates in place, so they are never
shuffled. A task packs its candidates, some thousands at a time, into postings by term. For each term a block's
query weights scatter the weighted postings into a dense array of scores; a partition selection takes the best of
each query, the task merges these as it goes, and a shuffle by query merges the tasks' selections. Scores are as
many as there are pairs; what is shuffled is k rows for each query and task.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. A
shorter vector counts as padded with zeros. Rows with the query's own id are no candidates of it; other
repeated rows each count. Ties go to the smaller id. Scores beyond a long are clipped to its range. Empty
tables give an empty table. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, in_arrow, materialize, stored

#: Rows of a block of queries and of a block of candidates; bytes of query blocks that a pass broadcasts.
QUERY_BLOCK, CANDIDATE_BLOCK, PASS_BYTES = 512, 4096, 16_000_000
_LONG = 2**63 - 1


def quantized(embedding: F.Column, scale: int = 256) -> F.Column:
    """floor(scale * x) of each component x, as an array of longs; null if any component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _pack(ids: list[int], vectors: list) -> dict[str, bytes]:
    """ids, and the non-zero weights by term, as packed arrays."""
    width = max(map(len, vectors), default=0)
    dense = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        dense[k, : len(v)] = v
    term, row = np.nonzero(dense.T)
    made = (np.array(ids, "<i8"), np.searchsorted(term, np.arange(width + 1)).astype("<i8"), row.astype("<i4"), dense.T[term, row].astype("<i8"))
    return {n: x.tobytes() for n, x in zip(_PARTS, made, strict=True)}


_PARTS = ("ids", "starts", "rows", "weights")


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, bytes]]:
    """id, weights -> blocks of at most ``size`` rows."""
    ids, vectors = [], []
    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            vectors.append(v)
            if len(ids) == size:
                yield _pack(ids, vectors)
                ids, vectors = [], []
    if ids:
        yield _pack(ids, vectors)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _packed(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([x[n]], pa.binary()) for n in _PARTS], names=list(_PARTS))

    return in_arrow(rows, pack, ", ".join(f"{n} binary" for n in _PARTS))


def _accumulate(q: dict, c: dict) -> np.ndarray:
    """Scores of all pairs, term by term."""
    (qs, qr, qw), (cs, cr, cw) = ((np.frombuffer(x["starts"], "<i8"), np.frombuffer(x["rows"], "<i4"), np.frombuffer(x["weights"], "<i8")) for x in (q, c))
    terms = min(len(qs), len(cs)) - 1
    most = (int(np.abs(qw).max(initial=0)) if len(qw) else 0) * (int(np.abs(cw).max(initial=0)) if len(cw) else 0) * max(terms, 1)
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    qw, cw = qw.astype(kind), cw.astype(kind)
    n = len(c["ids"]) // 8
    score = np.zeros((len(q["ids"]) // 8, n), kind)
    for t in range(terms):
        mine, theirs = slice(qs[t], qs[t + 1]), slice(cs[t], cs[t + 1])
        rows, weights, at, w = qr[mine], qw[mine], cr[theirs], cw[theirs]
        if 4 * len(at) > n:  # a long posting list is as quick to add whole
            posting = np.zeros(n, kind)
            posting[at] = w
            score[rows] += weights[:, None] * posting
        else:
            score[rows[:, None], at] += weights[:, None] * w
    return np.clip(score, -_LONG - 1, _LONG).astype(np.int64) if kind is object else score


def _best(q: dict, c: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query of a block the k best candidates of the other: query, candidate, score."""
    qid, cid = np.frombuffer(q["ids"], "<i8"), np.frombuffer(c["ids"], "<i8")
    score = _accumulate(q, c)
    out = [(np.empty(0, np.int64),) * 3]
    for r in range(len(qid)):
        at = np.flatnonzero(cid != qid[r])
        s = score[r, at].astype(np.int64)
        if len(at) > k:
            near = s >= np.partition(s, len(at) - k)[len(at) - k]
            at, s = at[near], s[near]
        order = np.lexsort((cid[at], ~s))[:k]
        out.append((np.full(len(order), qid[r]), cid[at[order]], s[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _merged(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query."""
    query, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((vec, ~score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[nth < k], vec[nth < k], score[nth < k]


def _searched(batches: Iterator[pa.RecordBatch], blocks: list[dict], size: int, k: int) -> Iterator[pa.RecordBatch]:
    """Candidates -> of each query of the blocks the k best among them."""
    held: list[tuple] = []
    room = 16 * k * sum(len(b["ids"]) // 8 for b in blocks)
    for c in _packed(batches, size):
        held += [x for x in (_best(b, c, k) for b in blocks) if len(x[0])]
        if sum(len(x[0]) for x in held) > room:
            held = [_merged(held, k)]
    if held:
        for x in [_merged(held, k)]:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in x], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", weights: str = "weights", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best vectors; both sides hold id_ and integer weights."""
    taking = lambda df: df.select(F.col(id_).cast("long").alias("id"), F.col(weights).alias("weights")).filter(F.col("id").isNotNull() & F.col("weights").isNotNull())
    vectors, blocks = taking(vectors), materialize(_blocks(taking(queries), query_block))
    size = blocks.agg(F.sum(sum(F.length(n) for n in _PARTS))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    selected = []
    for p in range(passes):
        mine = blocks.filter(F.pmod(F.xxhash64("ids"), F.lit(passes)) == p) if passes > 1 else blocks
        shared = vectors.sparkSession.sparkContext.broadcast([r.asDict() for r in mine.collect()])
        found = in_arrow(vectors, lambda b, shared=shared: _searched(b, shared.value, candidate_block, k), "query_id long, vec_id long, score long")
        selected.append(stored(found) if passes > 1 else found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, selected).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def dot_search(table: DataFrame, is_query: F.Column, k: int = 5, id_: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``search`` of those rows of a table of embeddings for which ``is_query`` holds, among all its rows."""
    name = fresh(table, "weights")
    rows = table.withColumn(name, quantized(F.col(embedding), scale))
    return search(rows, rows.filter(is_query), k, id_, name)
