"""A quality classifier by importance resampling.

Two bag-of-n-grams models over a fixed number of hash slots, one of the target texts (documents labelled as
good) and one of all texts, give each document its log importance weight: the sum over its features of the log
ratio of their probabilities. Features are words, word pairs and byte trigrams, lower-cased. Adding Gumbel noise
from a seeded hash of the id and the text, and taking the k largest sums, samples k documents without replacement
in proportion to their weights. The k-th largest sum is found by histograms over ever narrower ranges, without a
sort of all documents. ``length``, if given, takes the mean log ratio of a word times that many words instead.

Null and empty texts have weight 0, texts of any length count whole. Repeated rows (equal in id and text) get the
same weight and noise; rows that tie with the k-th are all taken, so more than k are if it is repeated. Labels with
a null id or label are left out; of repeated labels the largest counts; without labels half of the documents are
taken. An empty table gives an empty table. Columns of the result replace others of their names; only the id and
the text are looked at. The share of good labels is that of all labels; the models are fitted on all texts and on
about ``most_labels`` labelled ones at most, those with the smallest seeded hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, in_arrow, join_hash, materialize, mix, texts, word_hashes

#: Slots of a model, for words and pairs and for byte trigrams each.
SLOTS = 1 << 14
MOST_LABELS = 200_000
#: Bins of a histogram, and ties that may be sorted.
BINS, FEW = 4096, 20_000


def features(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all features of some texts, the text of each, and the texts' numbers of words."""
    h, n = word_hashes(rows, lower=True)
    doc = np.repeat(np.arange(len(rows)), n)
    same = doc[1:] == doc[:-1]
    pairs = join_hash(h[:-1], h[1:])[same]
    raw = np.frombuffer(b"".join(b or b"" for b in rows), np.uint8)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(U64)
    size = np.array([len(b or b"") for b in rows], np.int64)
    at = np.repeat(np.arange(len(rows)), size)
    three = mix(low[:-2] << U64(16) | low[1:-1] << U64(8) | low[2:]) if len(low) > 2 else np.empty(0, U64)
    inside = at[2:] == at[:-2] if len(low) > 2 else np.empty(0, bool)
    slots = [(x % U64(SLOTS)).astype(np.int64) for x in (h, pairs, three[inside])]
    slots[2] += SLOTS
    return np.concatenate(slots), np.concatenate([doc, doc[1:][same], at[2:][inside] if len(low) > 2 else at[:0]]), n


def _parts(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def fit(docs: DataFrame) -> np.ndarray:
    """docs: text, target. The log ratio of each slot's probability in the target model to that in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 2 * SLOTS), np.int64)
        for batch in (part for whole in batches for part in _parts(whole)):
            slot, doc, _ = features(texts(batch))
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            count[0] += np.bincount(slot, minlength=2 * SLOTS)
            count[1] += np.bincount(slot[target[doc]], minlength=2 * SLOTS)
        of, at = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(count[of, at])], names=["of", "slot", "n"])

    sums = in_arrow(docs.select("text", "target"), run, "of int, slot int, n long").groupBy("of", "slot").agg(F.sum("n").alias("n")).toPandas()
    count = np.ones((2, 2 * SLOTS))
    count[sums["of"].to_numpy(int), sums["slot"].to_numpy(int)] += sums["n"].to_numpy(float)
    share = count.reshape(2, 2, SLOTS)
    share = np.log(share / share.sum(axis=2, keepdims=True)).reshape(2, -1)
    return share[1] - share[0]


def largest(rows: DataFrame, k: int) -> float:
    """The k-th largest key, by histograms over ever narrower ranges; rows are never sorted as a whole."""
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    while True:
        step = (high - low) / BINS
        inside = rows.filter((F.col("key") >= low) & (F.col("key") <= high))
        if step <= 0 or low + step <= low:
            return low
        if inside.limit(FEW + 1).count() <= FEW:
            return inside.orderBy(F.desc("key")).limit(k).agg(F.min("key")).first()[0]
        cell = F.least(F.floor((F.col("key") - low) / step), F.lit(BINS - 1))
        found = sorted((r[0], r[1], r[2], r[3]) for r in inside.groupBy(cell.alias("cell")).agg(F.count("*"), F.min("key"), F.max("key")).collect())
        while k > found[-1][1]:
            k -= found.pop()[1]
        low, high = found[-1][2:]


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_: str = "doc_id", text: str = "text", length: float | None = None, share: float | None = None, seed: int = 11, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, log_weight, key (with noise) and kept; share of the documents is kept, by default that of good labels."""
    known = labels.filter(F.col(id_).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_).cast("long").alias("l_id")).agg(F.max(label).alias("label"))
    known = materialize(known)
    n, good_share = known.agg(F.count("*"), F.avg((F.col("label") > 0).cast("double"))).first()
    share = share if share is not None else 0.5 if good_share is None else good_share
    # A threshold on a uniform hash leaves about most_labels rows, so what is broadcast has a bound; no sort is needed.
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("l_id")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, most_labels / max(n, 1)))
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    good = F.broadcast(materialize(known.filter(part & (F.col("label") > 0)).select("l_id")))
    flagged = rows.join(good, F.col("doc_id") == F.col("l_id"), "left").select("text", F.col("l_id").isNotNull().alias("target"))
    ratio = docs.sparkSession.sparkContext.broadcast(fit(flagged))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in (part for whole in batches for part in _parts(whole)):
            slot, doc, n = features(texts(batch))
            sums = np.bincount(doc, table[slot], len(n)).astype(float)
            sums = sums if length is None else sums / np.maximum(n, 1) * length
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sums)], names=["doc_id", "drawn", "log_weight"])

    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 52))
    noise = -F.log(-F.log((F.col("drawn") + 0.5) / float(1 << 52)))
    weighed = in_arrow(rows.select("doc_id", "text", drawn.alias("drawn")), run, "doc_id long, drawn long, log_weight double")
    held = materialize(weighed.select("doc_id", "log_weight", (F.col("log_weight") + noise).alias("key")))
    k = round(share * held.count())
    return held.withColumn("kept", F.col("key") >= largest(held, k) if k else F.lit(False))
