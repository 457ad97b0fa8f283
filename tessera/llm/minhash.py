"""Near-duplicates by one-permutation MinHash with optimal densification, confirmed on full shingle sets.

Documents with one and the same shingle set are a class, found by a partial aggregation, and only a class's
representative goes on, so a group of exact copies costs one row. A representative's set is hashed once into
bins; an empty bin takes the value of a bin that a fixed sequence of probes reaches. Bands of bins are
buckets, and each bucket proposes a star: its least node with every other. Confirmed stars make components.
Buckets whose nodes are still in different components propose stars from other centres, and what then still
is apart goes through an exact set-similarity join (shingles ordered by rarity; prefix, length and positional
filters) that finds every remaining link between different components of a bucket; so stars lose none of the
links that share a bucket, and no bucket is paired out or cut off. A link whose documents share no bucket (see
``BANDS``) is found only through others.

Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows with a null
id take part; their component's id is the least id in it, null if there is none. Rows that repeat an id each
count. What ``dedupe`` keeps of a component is told by id and text, not by id alone, so null and repeated ids
neither lose nor bring back other texts. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, WORD, bounded, by_text, fresh, in_arrow, join_hash, materialize, mix, parts, texts, word_hashes
from tessera.llm.graph import components

WIDTH = 5
#: 100 * intersection >= PERCENT * union
PERCENT = 75
#: At a similarity of 0.75 a pair shares no bucket with a probability of (1 - 0.75 ** 4) ** 32 = 5e-6.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Ids that may be broadcast to fetch texts: 16 bytes each.
BROADCAST_IDS = 200_000
#: Further rounds of stars, from other centres, in buckets whose nodes are in different components.
ROUNDS = 2
#: Pairs of one node that a task compares.
PAIRS_EACH = 1000
#: Slots of the table of estimated shingle frequencies; it orders shingles only.
SLOTS = 1 << 17

_PROBES = (mix(np.arange(BINS * 400, dtype=U64) + U64(0x5851F42D)) % U64(BINS)).astype(np.int64).reshape(400, BINS)


def shingle_sets(rows: list[bytes | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a shorter text is one shingle."""
    for h in by_text(*word_hashes(rows, lower=True)):
        n = len(h)
        m = max(n - width + 1, 1)
        if not n:
            yield h
            continue
        acc = mix(h[:m] + U64(min(n, width)))
        for k in range(1, min(n, width)):
            acc = join_hash(acc, h[k : k + m])
        yield np.unique(acc)


def buckets(s: np.ndarray) -> np.ndarray:
    """The bucket of each band of a non-empty sorted set."""
    bins = (s >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    value, full = np.zeros(BINS, U64), np.zeros(BINS, bool)
    value[bins[first]] = s[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    for probe in _PROBES:
        if not len(empty):
            break
        at = probe[empty]
        hit = full[at]
        value[empty[hit]] = value[at[hit]]
        empty = empty[~hit]
    value[empty] = s[0]
    rows = value.reshape(BANDS, ROWS)
    acc = mix(np.arange(BANDS, dtype=U64) + U64(1))
    for k in range(ROWS):
        acc = join_hash(acc, rows[:, k])
    return acc.view(np.int64)


def signatures(docs: DataFrame, id_: str, text: str, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, key (a 128-bit hash of the set, null if it is empty), buckets; and the text's digest, if asked."""
    more = [_digest(F.col(text)).alias("digest")] if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            n, keys, found = [], [], []
            for s in shingle_sets(texts(batch), width):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found.append(buckets(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), *batch.columns[2:]], names=["doc_id", "n_shingles", "key", "buckets", *batch.schema.names[2:]])

    return in_arrow(docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"), *more), run, "doc_id long, n_shingles long, key binary, buckets array<long>" + ", digest binary" * digest)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sets(docs: DataFrame, id_: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """wanted: node, doc, key. node and the packed shingle set of that key, from a document of that id."""
    wanted = bounded(wanted.select("node", "doc", "key"), BROADCAST_IDS)
    held = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("doc"))).select("node", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = []
            for s, k in zip(shingle_sets(texts(batch), width), batch.column(1).to_pylist(), strict=True):
                packed = s.tobytes()
                made.append(packed if len(s) and xxhash.xxh3_128_digest(packed) == k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "set"]).filter(pa.array([x is not None for x in made], pa.bool_()))

    return in_arrow(held, run, "node long, set binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b. Those whose sets are similar enough.

    Pairs are dealt by their first node; a node with many pairs is dealt to as many tasks as it needs. Its set
    goes to each of these once, ahead of the sets it is compared with, so a task holds two sets at a time.
    """
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PAIRS_EACH)).cast("int").alias("tasks"))
    first = tasks.join(held, tasks["a"] == held["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "set")
    rest = pairs.join(tasks, "a").join(held, F.col("b") == F.col("node")).select("a", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("part"), "b", "set")
    met = first.unionByName(rest).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = None, np.empty(0, U64)
        for batch in batches:
            good = []
            for a, part, b, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                t = np.frombuffer(packed, U64)
                if b is None:
                    at, s = (a, part), t
                    good.append(False)
                    continue
                ok = at == (a, part) and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t))
                if ok:
                    x = np.sort(np.concatenate((s, t)), kind="stable")  # two sorted runs are merged
                    both = int((x[1:] == x[:-1]).sum())
                    ok = 100 * both >= percent * (len(s) + len(t) - both)
                good.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return in_arrow(met, run, "a long, b long")


def _frequencies(held: DataFrame) -> np.ndarray:
    """Estimated shingle frequencies: counts by slot, of a fixed number of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                np.add.at(count, (np.frombuffer(packed, U64) % U64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["slot", "n"])

    total = np.zeros(SLOTS, np.int64)
    sums = in_arrow(held.select("set"), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    total[sums["slot"].to_numpy(np.int64)] = sums["n"]
    return total


def _remaining(nodes: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """nodes: node, component. Every pair in different components that a prefix join of their sets proposes."""
    own = materialize(held.join(nodes, "node").select("node", "component", "set"))
    rarity = own.sparkSession.sparkContext.broadcast(_frequencies(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = rarity.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
            for x, c, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = np.frombuffer(packed, U64)
                n = len(s)
                first = s[np.lexsort((s, count[(s % U64(SLOTS)).astype(np.int64)]))][: n - -(-percent * n // 100) + 1]
                for col, v in zip(out, (first.view(np.int64), np.full(len(first), x), np.full(len(first), c), np.full(len(first), n), np.arange(len(first))), strict=True):
                    col.append(v.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names=["token", "node", "component", "n", "place"])

    rows = in_arrow(own, run, "token long, node long, component long, n long, place long")
    # a is the smaller set: of its tokens fewer need be looked at, since no smaller set than it takes part.
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns]) for x in "ab")
    a = a.filter(F.col("place_a") <= F.col("n_a") - F.ceil(2 * percent * F.col("n_a") / F.lit(100 + percent)))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    pairs = a.join(b, (F.col("token_a") == F.col("token_b")) & ordered & (F.col("component_a") != F.col("component_b")) & (100 * F.col("n_a") >= percent * F.col("n_b")) & room)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _components(held: DataFrame, docs: DataFrame, id_: str, text: str, width: int, percent: int) -> DataFrame:
    """held: signatures. key, doc (its least id) and component of each class."""
    classes = held.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    members = classes.select("node", F.explode("buckets").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("bucket", "centre")
    stars = materialize(members.join(centres, "bucket").select("bucket", "centre", "node"))
    involved = materialize(stars.select("node").distinct())
    wanted = classes.select("node", "doc", "key").join(involved, "node")
    sets = materialize(_sets(docs, id_, text, wanted, width))
    proposed = materialize(stars.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    links = materialize(_confirmed(proposed, sets, percent))
    found = materialize(components(links))
    for k in range(ROUNDS + 1):
        of = involved.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        in_buckets = (stars if k == 0 else unsettled).select("bucket", "node").join(of, "node")
        apart = in_buckets.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("bucket")
        unsettled = materialize(in_buckets.join(apart, "bucket").select("bucket", "node", "component"))
        if not unsettled.limit(1).count():
            break
        if k < ROUNDS:
            centre = unsettled.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), F.xxhash64("bucket", "node", F.lit(k))).alias("c"))
            proposed = unsettled.join(centre, "bucket").filter("component != c.component").select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        else:
            proposed = _remaining(unsettled.select("node", "component").distinct(), sets, percent)
        more = materialize(_confirmed(materialize(proposed), sets, percent))
        if more.limit(1).count():
            found = materialize(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    return classes.select("key", "node", "doc").join(found, "node", "left").select("key", "doc", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) and kept, a row for each document."""
    held = materialize(signatures(docs, id_, text, width))
    named = _components(held, docs, id_, text, width, percent)
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_key = named.join(least, "component").select(F.col("key").alias("class"), "component_id")
    out = held.join(by_key, F.col("key") == F.col("class"), "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedupe(docs: DataFrame, id_: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each group, its columns unchanged: the one with the least id (null last), then the least digest of
    its text, any one of rows that agree in both. Rows without words are groups of their own and all stay."""
    held = materialize(signatures(docs, id_, text, width, digest=True))
    named = _components(held, docs, id_, text, width, percent).select("key", "component")
    rows = held.filter(F.col("key").isNotNull()).groupBy("key", "doc_id", "digest").agg(F.count("*").alias("n"))
    firsts = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "n")).alias("first"))
    kept = materialize(firsts.join(named, "key").groupBy("component").agg(F.min("first").alias("first")).select("first.*"))
    own, digest = fresh(docs, "own"), fresh(docs, "digest")
    # Rows without words all have one identity, which is kept.
    some = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    more = docs.withColumns({own: F.when(some, F.col(id_).cast("long")), digest: F.when(some, _digest(F.col(text))).otherwise(F.lit(b""))})

    def of(these: DataFrame) -> DataFrame:
        these = bounded(these.select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept_digest")), BROADCAST_IDS)
        return more.join(these, F.col(own).eqNullSafe(F.col("__kept_id")) & (F.col(digest) == F.col("__kept_digest")), "left_semi")

    blank = docs.sparkSession.createDataFrame([(None, b"")], "doc_id long, digest binary")
    out = of(kept.filter("n = 1").select("doc_id", "digest").unionByName(blank))
    again = kept.filter("n > 1")
    if again.limit(1).count():
        out = out.unionByName(of(again).dropDuplicates([own, digest]))
    return out.select(*docs.columns)
