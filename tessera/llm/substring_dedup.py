"""Substring dedup: windows of words that occur more than once, found by backward search in FM-indexes.

Windows are routed to index shards by their content: a window's anchor is the least hash of the grams in it,
so equal windows have equal anchors, and a run of windows with one anchor is a segment. Anchors that occur
once in the corpus, counted by shard over distinct anchors of blocks of documents, cannot have a repeated
window. Segments of the others are aggregated by content, so copies cost one row. Each shard builds
compressed FM-indexes (wavelet matrices) over its segments and streams them through backward search, which
gives matching statistics: how far left from a position the text still occurs as often as needed. Windows
inside long enough matches are repeated. A shard indexes whole anchors in blocks of bounded size. The segments
of an anchor that many different segments share (a phrase found in many contexts) are cut further, by the least
grams under two more hash functions, and each run of windows that agrees in all three is dealt by itself; should
such a group still be larger than a block, it is indexed block by block, and its segments are streamed to each.

Words are compared by 64-bit hashes. Null text has no words; texts shorter than a window keep all words;
repeated rows repeat each other's windows; an empty table gives an empty table. Input columns named like a
result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, bounded, fresh, in_arrow, join_hash, materialize, mix, parts, texts, with_arrow, word_hashes
from tessera.llm.fm_index import FMIndex

WIDTH = 35
GRAM = 12
#: Bytes of a block of documents, words of an index, and characters of text for each shard of anchors.
BLOCK_BYTES, INDEX_WORDS, SHARD_CHARS = 1_000_000, 400_000, 60_000_000
#: Different segments from which an anchor is cut further, and the seeds of the hash functions that do it.
HOT_SEGMENTS, SEEDS = 4096, (U64(0x5DEECE66D), U64(0x9E3779B9))
#: Segments whose grams are looked at together.
_AT_ONCE = 8192
#: The longest pattern that is searched.
DEPTH = 64

_RANGE = WIDTH - GRAM + 1


def _sliding_least(x: np.ndarray, length: int) -> np.ndarray:
    size, m = 1, x
    while 2 * size <= length:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (length - size)], m[length - size :]) if size < length else m


def _grams(h: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each position."""
    g2 = join_hash(h[:-1], h[1:])
    g4 = join_hash(g2[:-2], g2[2:])
    g8 = join_hash(g4[:-4], g4[4:])
    return join_hash(g8[:-4], g4[8:])


def segments(h: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: doc, start (word in the doc), windows, anchor, many (the anchor recurs in it), at."""
    none = {k: np.empty(0, np.int64) for k in ("doc", "start", "windows", "many", "at")} | {"anchor": np.empty(0, U64)}
    if len(h) < WIDTH:
        return none
    gram = _grams(h)
    least = _sliding_least(gram, _RANGE)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[: len(least)]
    valid = np.arange(WIDTH, len(least) + WIDTH, dtype=np.int32) <= ends.astype(np.int32)[doc]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return none
    total = np.concatenate(([0], np.cumsum(valid, dtype=np.int32)))
    windows = np.diff(np.append(total[first], total[-1])).astype(np.int64)
    anchor, span, many = least[first], windows + _RANGE - 1, np.empty(len(first), np.int64)
    for k in range(0, len(first), _AT_ONCE):
        part = slice(k, k + _AT_ONCE)
        starts = np.cumsum(span[part]) - span[part]
        inside = np.repeat(first[part] - starts, span[part]) + np.arange(int(span[part].sum()))
        many[part] = np.add.reduceat(gram[inside] == np.repeat(anchor[part], span[part]), starts, dtype=np.int64) > 1
    d = doc[first].astype(np.int64)
    return {"doc": d, "start": first - (ends - counts)[d], "windows": windows, "anchor": anchor, "many": many, "at": first}


def cuts(h: np.ndarray, anchor: int) -> Iterator[tuple[int, int, int]]:
    """The windows of a segment in runs with one least gram under each of SEEDS: key, first word, words."""
    gram = _grams(h)
    least = [_sliding_least(mix(gram ^ seed), _RANGE) for seed in SEEDS]
    new = np.flatnonzero(np.concatenate(([True], (least[0][1:] != least[0][:-1]) | (least[1][1:] != least[1][:-1]))))
    key = join_hash(join_hash(np.full(len(new), anchor, np.int64).view(U64), least[0][new]), least[1][new]).view(np.int64)
    to = np.append(new[1:], len(least[0]))
    yield from zip(key.tolist(), new.tolist(), (to - new + WIDTH - 1).tolist(), strict=True)


_ROW = "shard int, kind int, block long, a binary, b binary, c binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[3:]]], names=[x.split()[0] for x in _ROW.split(", ")])


def _anchors(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A block's documents with their segments' anchors by place, and its distinct anchors by shard."""
    seq = 0
    for part in parts(batches, BLOCK_BYTES):
        block = TaskContext.get().partitionId() << 32 | seq
        seq += 1
        s = segments(*word_hashes(texts(part), lower=False))
        anchor, inverse = np.unique(s["anchor"], return_inverse=True)
        if not len(anchor):
            continue
        many = (np.bincount(inverse, 1 + s["many"]) > 1).astype(np.uint8)
        shard = (mix(anchor) % U64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = part.column(part.schema.get_field_index("key")).to_pylist()
        per_doc = np.bincount(s["doc"], minlength=len(keys))
        rows = [(block % shards, 1, block, b"".join(keys), per_doc.astype("<u4").tobytes(), place[inverse].astype("<u4").tobytes())]
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[k] : cut[k + 1]]
            rows.append((k, 2, block, anchor[at].tobytes(), many[at].tobytes(), None))
        yield _rows(rows)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard: which anchors of each block occur more than once."""
    at, held = None, []

    def done() -> pa.RecordBatch:
        keys = [np.frombuffer(x[1], U64) for x in held]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, 1 + np.concatenate([np.frombuffer(x[2], np.uint8) for x in held]))
        good, ends = (n > 1)[inverse], np.cumsum([len(k) for k in keys])
        return _rows([(at, 2, x[0], good[e - len(k) : e].astype(np.uint8).tobytes(), None, None) for x, k, e in zip(held, keys, ends, strict=True)])

    for batch in batches:
        passed = []
        for s, kind, block, a, b, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if kind == 1:
                passed.append((-1, 1, block, a, b, c))
                continue
            if s != at:
                if held:
                    yield done()
                at, held = s, []
            held.append((block, a, b))
        if passed:
            yield _rows(passed)
    if held:
        yield done()


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block: the ordinals of each document's segments whose anchors recur."""
    at, info, flags = None, None, []

    def done() -> pa.RecordBatch:
        keys, per_doc, place = [info[0][k : k + 16] for k in range(0, len(info[0]), 16)], np.frombuffer(info[1], "<u4"), np.frombuffer(info[2], "<u4")
        hit = np.frombuffer(b"".join(flags), np.uint8)[place] > 0
        ends = np.cumsum(per_doc, dtype=np.int64)
        found = [(k, np.flatnonzero(hit[e - n : e]).astype("<u4").tobytes()) for k, e, n in zip(keys, ends.tolist(), per_doc.tolist(), strict=True) if hit[e - n : e].any()]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], names=["key", "ordinals"])

    for batch in batches:
        for s, _, block, a, b, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if block != at:
                if at is not None:
                    yield done()
                at, flags = block, []
            if s < 0:
                info = (a, b, c)
            else:
                flags.append(a)
    if at is not None:
        yield done()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ordinals, text -> the flagged segments: anchor, segment (a hash of its words), key, start, words."""
    for part in parts(batches, BLOCK_BYTES):
        h, counts = word_hashes(texts(part), lower=False)
        s = segments(h, counts)
        first = np.concatenate(([0], np.cumsum(np.bincount(s["doc"], minlength=part.num_rows))))
        pick = np.concatenate([first[k] + np.frombuffer(x, "<u4").astype(np.int64) for k, x in enumerate(part.column(1).to_pylist())] or [np.empty(0, np.int64)])
        words = s["windows"][pick] + WIDTH - 1
        at = s["at"][pick]
        names = [xxhash.xxh3_64_intdigest(h[a : a + n].tobytes()) for a, n in zip(at.tolist(), words.tolist(), strict=True)]
        keys = part.column(0).take(pa.array(s["doc"][pick]))
        yield pa.RecordBatch.from_arrays([pa.array(s["anchor"][pick].view(np.int64)), pa.array(np.array(names, U64).view(np.int64)), keys, pa.array(s["start"][pick].astype(np.int32)), pa.array(words.astype(np.int32))], names=["anchor", "segment", "key", "start", "words"])


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and wanted segments -> each one's words as text, those of hot anchors in several cuts."""
    for batch in parts(batches, BLOCK_BYTES):
        rows = []
        for b, wanted in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
            words = (b or b"").split()
            h, _ = word_hashes([b], lower=False)
            for w in wanted:
                start, n = w["start"], w["words"]
                for key, at, size in cuts(h[start : start + n], w["anchor"]) if w["hot"] else [(w["anchor"], 0, n)]:
                    rows.append((key, w["anchor"], w["segment"], at, w["n"], b" ".join(words[start + at : start + at + size])))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "anchor", "segment", "at", "n", "payload"])


def _repeated(index: _Closed, ids: np.ndarray, first: np.ndarray, last: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which positions of ids start a repeated window; segment k has windows from first[k] to last[k]."""
    found = np.zeros(len(ids) + 1, np.int64)
    step = DEPTH - WIDTH + 1
    chunks = -(-(last - first + 1) // step)
    of = np.repeat(np.arange(len(first)), chunks)
    a = first[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    b = np.minimum(a + step - 1, last[of])
    need, whole = least[of], np.ones(len(a), bool)

    def mark(x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(found, x, 1)
        np.add.at(found, y + 1, -1)

    while len(a):
        # A whole range is searched from its right end as one text; other ranges from the left, a window at a time.
        end = np.where(whole, b, a) + WIDTH - 1
        j = index.matching(ids, end, a, need)
        got = whole & (j <= b)
        mark(np.maximum(j, a)[got], b[got])
        one = ~whole & (j <= a)
        mark(a[one], a[one])
        split = whole & (j > a)
        right = np.where(j <= b, j - 1, b - 1)
        na = [np.maximum(a, j - WIDTH)[split], a[split], np.where(one, a + 1, j)[~whole]]
        nb = [right[split], (j - WIDTH - 1)[split], b[~whole]]
        nw = [np.zeros(split.sum(), bool), np.ones(split.sum(), bool), np.zeros((~whole).sum(), bool)]
        nn = [need[split], need[split], need[~whole]]
        a, b, whole, need = (np.concatenate(x) for x in (na, nb, nw, nn))
        live = a <= b
        a, b, whole, need = a[live], b[live], whole[live], need[live]
    return np.cumsum(found)[:-1] > 0


def _search(held: list[tuple], limit: int) -> Iterator[tuple[int, int, bytes]]:
    """Segments of whole keys -> anchor, segment and the spans of words in repeated windows (packed start, end)."""
    h, counts = word_hashes([x[5] for x in held], lower=False)
    values, ids = np.unique(h, return_inverse=True)
    ends = np.cumsum(counts)
    blocks, at = [], 0
    while at < len(held):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        blocks.append((at, to))
        at = to
    gap = np.arange(len(held))
    text = np.zeros(len(ids) + len(held), np.int64)
    text[np.arange(len(ids)) + np.repeat(gap, counts)] = ids + 1
    first = ends - counts + gap
    last = first + counts - WIDTH
    times = np.array([x[4] for x in held])
    hit = np.zeros(len(text), bool)
    for lo, hi in blocks:
        index = FMIndex(text[first[lo] : first[hi - 1] + counts[hi - 1] + 1], DEPTH)
        own = (gap >= lo) & (gap < hi)
        # A window is repeated if it occurs elsewhere: in its own block once more, unless its segment has copies.
        hit |= _repeated(_Closed(index), text, first, last, np.where(own & (times < 2), 2, 1))
    for k, (_, anchor, segment, at, *_) in enumerate(held):
        w = hit[first[k] : last[k] + 1]
        if w.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], w.astype(np.int8), [0]))))
            spans = np.stack((edge[::2], edge[1::2] + WIDTH - 1), 1) + at
            yield anchor, segment, spans.astype("<u4").tobytes()


class _Closed:
    """An index for texts that may have symbols which it does not know; those match nothing."""

    def __init__(self, index: FMIndex):
        self.index, self.top = index, len(index.starts)

    def matching(self, symbols: np.ndarray, ends: np.ndarray, floors: np.ndarray, least: np.ndarray) -> np.ndarray:
        if symbols.max(initial=0) < self.top:
            return self.index.matching(symbols, ends, floors, least)
        known = np.concatenate(([0], np.maximum.accumulate(np.where(symbols >= self.top, np.arange(len(symbols)) + 1, 0))))
        barred = known[ends + 1]  # one past the last unknown symbol up to each end
        j = ends + 1
        open_ = barred <= ends
        j[open_] = self.index.matching(np.minimum(symbols, self.top - 1), ends[open_], np.maximum(floors, barred)[open_], least[open_])
        return j


def _indexed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows by key: indexes over whole keys, each searched with its own segments."""
    held, words, last = [], 0, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["anchor", "segment", "spans"])

    for batch in batches:
        for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if words > limit and row[0] != last:
                yield out(list(_search(held, limit)))
                held, words = [], 0
            held.append(row)
            words += row[5].count(b" ") + 1
            last = row[0]
    if held:
        yield out(list(_search(held, limit)))


def spans(docs: DataFrame, shards: int | None = None, index_words: int = INDEX_WORDS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """docs: key, text. key and its repeated spans, as an array of (start, spans) structs."""
    spark = docs.sparkSession
    if shards is None:
        shards = max(16, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS))
    sent = in_arrow(docs.select("key", "text"), lambda b: _anchors(b, shards), _ROW)
    answers = in_arrow(sent.repartition(shards, "shard").sortWithinPartitions("shard"), _answers, _ROW)
    flagged = in_arrow(answers.repartition("block").sortWithinPartitions("block", "shard"), _flagged, "key binary, ordinals binary")
    flagged = materialize(flagged.dropDuplicates(["key"]))
    wanted = docs.join(flagged, "key").select("key", "ordinals", "text")
    found = materialize(in_arrow(wanted, _occurrences, "anchor long, segment long, key binary, start int, words int"))
    distinct = materialize(found.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "words")).alias("x")))
    hot = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("m")).filter(F.col("m") > hot_segments).select("anchor", F.lit(True).alias("hot")))
    marked = distinct.join(bounded(hot), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by_doc = materialize(marked.groupBy("x.key").agg(F.collect_list(F.struct("anchor", "segment", "n", "x.start", "x.words", "hot")).alias("wanted")))
    first = docs.select("key", "text").join(by_doc, "key").dropDuplicates(["key"]).select("text", "wanted")
    payloads = in_arrow(first, _payloads, "key long, anchor long, segment long, at int, n long, payload binary")
    parts_ = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    searched = in_arrow(payloads.repartition(parts_, "key").sortWithinPartitions("key"), lambda b: _indexed(b, index_words), "anchor long, segment long, spans binary")
    return found.join(materialize(searched), ["anchor", "segment"]).groupBy("key").agg(F.collect_set(F.struct("start", "spans")).alias("found"))


def remove_repeats(docs: DataFrame, id_: str = "doc_id", text: str = "text", shards: int | None = None, index_words: int = INDEX_WORDS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``docs`` with n_words, n_removed, and kept_text: the words in no repeated window, joined by single spaces."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    key, found, made = (fresh(docs, x) for x in ("key", "found", "made"))
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col(id_).cast("string"), F.lit("null")), F.col(text)))))
    removed = materialize(spans(keyed.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), shards, index_words, hot_segments))
    joined = keyed.join(removed.select(F.col("key").alias(key), F.col("found").alias(found)), key, "left")
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    arrow = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def of(batch: pa.RecordBatch) -> pa.Array:
        rows = []
        for b, spans_ in zip(texts(batch, text), batch.column(batch.schema.get_field_index(found)).to_pylist(), strict=True):
            words = (b or b"").split()
            n = len(words)
            if spans_:
                gone = np.zeros(n, bool)
                for x in spans_:
                    for s, e in np.frombuffer(x["spans"], "<u4").reshape(-1, 2).tolist():
                        gone[x["start"] + s : x["start"] + e] = True
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            rows.append((n, n - len(words), b" ".join(words).decode("utf-8", "replace")))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], names=[f.name for f in arrow])

    out = with_arrow(joined, made, kind, of, arrow, text)
    return out.select(*docs.columns, f"{made}.n_words", f"{made}.n_removed", f"{made}.kept_text")
