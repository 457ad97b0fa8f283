"""Language-model scores by a weighted backoff automaton whose n-grams are all those of the training texts.

States are contexts: the root, words, and pairs of words. An arc of a state is a word that follows the context
in training; a failure arc leads to the next shorter context. With C the context's count and c the continuation's,
the failure arc has the weight f = FAIL * C ** -FALL, and an arc the probability (1 - f) * c / C + f * p, where p is
the shorter context's, so every state is a distribution over all words (Jelinek-Mercer smoothing by the count of the
context, as new continuations become rarer as a power of it).
The root's arcs are the add-0.1 unigrams. A text is walked once from left to right: the walk carries its state, follows the
arc of the token if the state has one, and else takes failure arcs until a state has, and adds up the log weights of
what it takes. An arc leads to the longest context that training has of the words behind it.

No n-gram is left out, so the automaton grows with the corpus and lives in shards. A block of documents (a few
MB) sends its distinct words, pairs and triples, with how often its training texts have them, to their shards; a
shard adds up what it gets and sends each block its counts back; the block, whose texts went along, then has the
automaton's part that they walk through. Sorted codes travel as differences, whose upper bytes are compressed. A
shard holds about SHARD_KEYS keys at any size of the corpus, and besides one key a block for each n-gram that is
found nearly everywhere. Words are told by 64 bits; pairs and triples by TOLD bits besides their shard's, so one in
250,000 is taken for another.

Null and empty texts have the end token only. A null id counts as held out: nothing is learnt from it. Repeated
rows each count and are scored each. Texts of any length are walked whole. An empty table gives an empty table.
Other columns than the id and the text are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, in_arrow, join_hash, mix, parts, texts, word_hashes

END = U64(xxhash.xxh64_intdigest(b"\n"))
ADD = 0.1
#: A context that occurs C times leaves FAIL * C ** -FALL to continuations that training does not have after it.
FAIL, FALL = 0.95, 0.2
#: Bytes of text of a block; keys of a shard, on average; bits of the number of shards, at least and at most.
BLOCK_BYTES, SHARD_KEYS, LEAST_BITS, MOST_BITS = 6_000_000, 250_000, 8, 24
#: Bits that tell the pairs and triples of a shard; distinct words that a task counts at a time.
TOLD, HELD = 36, 1_000_000
#: The level of compression: bytes on disk are dearer here than time.
LEVEL = 6
#: Bytes of text for each key that is sent, about: a token and its blank have 6.5 and make 1.9 keys.
BYTES_A_KEY = 3.4


def tokens(batch: pa.RecordBatch, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a batch's texts, one after the other, and the number of tokens of each."""
    held = texts(batch)
    words, n = word_hashes(held if rows is None else [b for b, r in zip(held, rows, strict=True) if r], lower=True)
    n = n + 1
    out = np.full(int(n.sum()), END, U64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = words
    return out, n


def grams(words: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Mixed keys of the word, pair and triple that end at each token. A text follows on an end; its first token has
    no triple, and the word's key stands in its place."""
    first = np.cumsum(n) - n
    last = np.empty_like(words)
    last[1:] = words[:-1]
    last[first] = END
    pair = join_hash(last, words)
    triple = np.empty_like(words)
    triple[1:] = join_hash(pair[:-1] ^ END, words[1:])
    triple[first] = words[first]
    return [mix(words), pair, triple]


def _codes(words: np.ndarray, n: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs and triples: the distinct codes, ascending and so by shard, and each token's place in them."""
    return [np.unique(key if k == 0 else key >> U64(64 - TOLD - bits), return_inverse=True) for k, key in enumerate(grams(words, n))]


def _width(x: np.ndarray) -> int:
    most = int(x.max(initial=0))
    return 1 if most < 1 << 8 else 4 if most < 1 << 32 else 8


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    """The bytes of each place of some integers, place by place."""
    return np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T


def _whole(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


@functools.cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=LEVEL)


def packed(counts: list[np.ndarray], codes: list[np.ndarray] | None = None) -> tuple[bytes, bytes, bytes]:
    """Lists of counts, and of sorted codes to them: a head, bytes that are as good as random, and compressed others."""
    head, hard, soft = [], [], []
    for k, count in enumerate(counts):
        m, low, width = len(count), 0, _width(count)
        if codes is not None and m:
            planes = _planes(np.diff(codes[k], prepend=U64(0)), 8)
            low = min(8, max(0, int(np.log2(max(float(codes[k][-1]) / m, 1))) // 8))
            hard.append(planes[:low].tobytes())
            soft.append(planes[low:].tobytes())
        soft.append(_planes(count, width).tobytes())
        head += [m, low, width]
    soft = b"".join(soft)
    return np.array([*head, len(soft)], "<u4").tobytes(), b"".join(hard), _codec().compress(soft, asbytes=True)


def unpacked(head: bytes, hard: bytes, soft: bytes, coded: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The counts and, if there are any, the codes."""
    *head, size = np.frombuffer(head, "<u4").tolist()
    soft = np.frombuffer(_codec().decompress(soft, size, asbytes=True), np.uint8)
    hard, counts, codes, at, to = np.frombuffer(hard, np.uint8), [], [], 0, 0
    for m, low, width in zip(head[::3], head[1::3], head[2::3], strict=True):
        if coded:
            high = (8 - low) * m
            planes = np.concatenate((hard[to : to + low * m], soft[at : at + high])).reshape(8, m)
            codes.append(np.cumsum(_whole(planes), dtype=U64))
            at, to = at + high, to + low * m
        counts.append(_whole(soft[at : at + width * m].reshape(width, m)))
        at += width * m
    return counts, codes


_WORDS = "shard int, a binary, b binary, c binary, total long"


def vocabulary(rows: DataFrame, bits: int) -> tuple[int, int]:
    """rows: text, train. The training texts' tokens and distinct tokens."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def flush() -> pa.RecordBatch:
            word = np.unique(np.concatenate(held))
            cut = np.searchsorted(word >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
            full = np.flatnonzero(np.diff(cut))
            rows = [(s, *packed([np.zeros(cut[s + 1] - cut[s], np.int64)], [word[cut[s] : cut[s + 1]]]), total if k == 0 else 0) for k, s in enumerate(full.tolist())]
            return _rows(rows, _WORDS)

        for batch in parts(batches, BLOCK_BYTES):
            words, _ = tokens(batch, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
            total += len(words)
            held.append(np.unique(mix(words)))
            size += len(held[-1])
            if size > HELD:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                if size > HELD // 2:
                    yield flush()
                    held, size, total = [], 0, 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, total, n = None, [], 0, 0

        def distinct() -> int:
            held[:] = [np.unique(np.concatenate(held))] if held else []
            return len(held[0]) if held else 0

        for batch in batches:
            for s, a, b, c, more in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if s != at:
                    n += distinct()
                    at, held = s, []
                held.append(unpacked(a, b, c, coded=True)[1][0])
                total += more
                if len(held) > 64:
                    distinct()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([n + distinct()], pa.int64())], names=["total", "distinct"])

    sent = in_arrow(rows.select("text", "train"), send, _WORDS)
    counted = in_arrow(sent.repartition("shard").sortWithinPartitions("shard"), merge, "total long, distinct long")
    total, distinct = counted.agg(F.sum("total"), F.sum("distinct")).first()
    return total or 0, distinct or 0


_SENT = "shard int, kind int, block long, a binary, b binary, c binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK_BYTES of text."""
    held, size = [], 0
    for part in parts(batches, BLOCK_BYTES):
        if held and size + part.nbytes > BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += part.nbytes
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """For each block a row of its documents (kind 0), and its distinct words, pairs and triples with their counts in
    training, by shard (kind 1)."""
    for seq, part in enumerate(_gathered(batches)):
        block = TaskContext.get().partitionId() << 32 | seq
        words, n = tokens(part)
        train = np.repeat(~part.column(1).to_numpy(zero_copy_only=False).astype(bool), n)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=_codec())) as w:
            w.write_batch(part)
        spread = int(mix(np.array([block], U64))[0] >> U64(64 - bits))
        yield _rows([(spread, 0, block, sink.getvalue().to_pybytes(), None, None)], _SENT)
        found = []
        for k, (code, place) in enumerate(_codes(words, n, bits)):
            cut = np.searchsorted(code >> U64(64 - bits if k == 0 else TOLD), np.arange((1 << bits) + 1, dtype=U64))
            found.append((code, np.bincount(place[train], minlength=len(code)), cut))
        full = np.flatnonzero(sum(np.diff(cut) for *_, cut in found)).tolist()
        for lo in range(0, len(full), 256):
            rows = []
            for s in full[lo : lo + 256]:
                base = [U64(s << (64 - bits)), *[U64(s << TOLD)] * 2]
                own = [(code[cut[s] : cut[s + 1]] - b, count[cut[s] : cut[s + 1]]) for (code, count, cut), b in zip(found, base, strict=True)]
                rows.append((s, 1, block, *packed([count for _, count in own], [code for code, _ in own])))
            yield _rows(rows, _SENT)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


_ANSWER = "block long, shard int, a binary, b binary, c binary"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard: to each block the counts of its words, pairs and triples in all blocks; its own row."""
    at, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        sums = []
        for k in range(3):
            every, place = np.unique(np.concatenate([codes[k] for _, _, codes in held]), return_inverse=True)
            count = np.bincount(place, np.concatenate([counts[k] for _, counts, _ in held]), len(every)).astype(np.int64)
            sums.append((count[place], np.cumsum([0, *(len(codes[k]) for _, _, codes in held)]).tolist()))
        for lo in range(0, len(held), 256):
            mine = range(lo, min(lo + 256, len(held)))
            yield _rows([(held[i][0], at, *packed([count[ends[i] : ends[i + 1]] for count, ends in sums])) for i in mine], _ANSWER)

    for batch in batches:
        passed = []
        for s, kind, block, a, b, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if s != at:
                if held:
                    yield from done()
                at, held = s, []
            if kind == 0:
                passed.append((block, -1, a, None, None))
            else:
                held.append((block, *unpacked(a, b, c, coded=True)))
        if passed:
            yield _rows(passed, _ANSWER)
    if held:
        yield from done()


@dataclass
class Automaton:
    """The states and arcs that a block's texts can meet. State 0 is the root; those of words and of pairs follow.

    fail and fail_log: each state's failure arc, to the next shorter context, and its log10 weight. arcs, for words, pairs
    and triples: of each of the block's n-grams the state that its arc leaves (-1 if training lacks it), the arc's log10
    probability, and the state that it leads to. start is where a text begins.
    """

    start: int
    pairs: int
    fail: list[int]
    fail_log: list[float]
    arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(places: list[np.ndarray], counts: list[np.ndarray], n: np.ndarray, total: int, distinct: int) -> Automaton:
        """places: of each token its word, pair and triple among the distinct ones; counts: of these, in training."""
        (w, v, t), (one, two, three) = places, counts
        words, pairs, first = len(one), len(two), np.cumsum(n) - n
        end = w[first[0] + n[0] - 1]
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[first] = end
        inner = np.setdiff1d(np.arange(len(w)), first)  # a text's first token ends no triple
        at2, at3 = np.zeros(pairs, np.int64), np.full(len(three), -1)
        at2[v], at3[t[inner]] = np.arange(len(w)), inner
        fall = lambda c: FAIL * np.maximum(c, 1) ** -FALL
        p1 = (one + ADD) / (total + ADD * (distinct + 1))
        a, f1, f2 = before[at2], fall(one), fall(two)
        p2 = (1 - f1[a]) * two / np.maximum(one[a], 1) + f1[a] * p1[w[at2]]
        source, ends = v[np.maximum(at3 - 1, 0)], v[at3]
        p3 = (1 - f2[source]) * three / np.maximum(two[source], 1) + f2[source] * p2[ends]
        pair = lambda x: 1 + words + x
        there = (at3 >= 0) & (three > 0)
        arcs = [
            (np.zeros(words, np.int64), np.log10(p1), np.where(one > 0, 1 + np.arange(words), 0)),
            (np.where(two > 0, 1 + a, -1), np.log10(np.where(two > 0, p2, 1)), pair(np.arange(pairs))),
            (np.where(there, pair(source), -1), np.log10(np.where(there, p3, 1)), np.where(there, pair(ends), -2)),
        ]
        fail = np.concatenate(([0], np.zeros(words, np.int64), 1 + w[at2])).tolist()
        return Automaton(int(1 + end) if one[end] > 0 else 0, 1 + words, fail, np.log10(np.concatenate(([1.0], f1, f2))).tolist(), arcs)

    def walk(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, failed: list[int] | None = None) -> float:
        """The log10 probability of a text, by one walk from left to right; ``failed`` gets how often each token failed.

        Arcs of triples that lead into one another are taken together, by their running sum.
        """
        parts = [x[i] for arc, i in zip(self.arcs, (words, pairs, triples), strict=True) for x in arc]
        _, log1, to1, from2, log2, to2, from3, log3, to3 = parts
        ends = np.append(np.flatnonzero(from3[1:] != to3[:-1]), len(words) - 1)  # where a run of such arcs ends
        sums = np.concatenate(([0.0], np.cumsum(log3)))
        if 10 * len(ends) > len(words):  # many short runs are quicker as lists
            log1, to1, from2, log2, to2, from3, to3, ends, sums = (x.tolist() for x in (log1, to1, from2, log2, to2, from3, to3, ends, sums))
        fail, fail_log, state, total, i, k, n = self.fail, self.fail_log, self.start, 0.0, 0, 0, len(words)
        while i < n:
            fails = 0
            if from3[i] == state:
                while ends[k] < i:
                    k += 1
                at = ends[k]
                total += sums[at + 1] - sums[i]
                state = to3[at]
                if failed is not None:
                    failed += [0] * (at + 1 - i)
                i = at + 1
                continue
            if state >= self.pairs:
                total += fail_log[state]
                state = fail[state]
                fails = 1
            if from2[i] == state:
                total += log2[i]
                state = to2[i]
            else:
                if state:
                    total += fail_log[state]
                    state = fail[state]
                    fails += 1
                total += log1[i]
                state = to1[i]
            if failed is not None:
                failed.append(fails)
            i += 1
        return float(total)


def traverse(places: list[np.ndarray], n: np.ndarray, counts: list[np.ndarray], total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the log10 probability by words alone, and by the automaton; places and counts as in ``Automaton.of``."""
    machine = Automaton.of(places, counts, n, total, distinct)
    first = np.cumsum(n) - n
    base = np.add.reduceat(machine.arcs[0][1][places[0]], first)
    return base, np.array([machine.walk(*(p[a : a + k] for p in places)) for a, k in zip(first.tolist(), n.tolist(), strict=True)])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(batches: Iterator[pa.RecordBatch], bits: int, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Rows by block, its own first and then the shards' counts in their order."""
    at, own, held = None, b"", [[], [], []]

    def done() -> pa.RecordBatch:
        docs = pa.ipc.open_stream(own).read_all().combine_chunks().to_batches()[0]
        words, n = tokens(docs)
        places, counts = [place for _, place in _codes(words, n, bits)], [np.concatenate(x) for x in held]
        known = np.add.reduceat((counts[0] > 0)[places[0]], np.cumsum(n) - n, dtype=np.int64)
        sums = [pa.array(x) for x in traverse(places, n, counts, total, distinct)]
        return pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), pa.array(n), pa.array(known), *sums], names=[x.split()[0] for x in _SCORED.split(", ")])

    for batch in batches:
        for block, shard, a, b, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if block != at:
                if at is not None:
                    yield done()
                at, held = block, [[], [], []]
            if shard < 0:
                own = a
                continue
            for x, count in zip(held, unpacked(a, b, c, coded=False)[0], strict=True):
                x.append(count.astype(np.float64))
    if at is not None:
        yield done()


def score(docs: DataFrame, id_: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of every document."""
    held = F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 10 == 0, F.lit(True))
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), held.alias("held_out"), (~held).alias("train"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1.0, size / BYTES_A_KEY / shard_keys))))))
    total, distinct = vocabulary(rows, bits)
    sent = in_arrow(rows.select("doc_id", "held_out", "text"), lambda b: _blocks(b, bits), _SENT)
    answers = in_arrow(sent.repartition("shard").sortWithinPartitions("shard", "kind"), _answers, _ANSWER)
    back = answers.repartition("block").sortWithinPartitions("block", "shard")
    scored = in_arrow(back, lambda b: _scored(b, bits, total, distinct), _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
