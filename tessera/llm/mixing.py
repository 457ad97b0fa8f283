"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. The flow network has a node for each pattern
and each source: tokens run from a pattern to its sources and on to the sources' quotas, and the k-th pass
over a pattern's tokens costs k * k, so that repetition spreads evenly. The network's size depends on the
number of patterns only. Within a pattern every document gets the whole passes, and the rest of the flow goes
to documents in the order of a seeded hash: histograms over ever narrower hash ranges find where the running
sum passes it. The document there is skipped, and the search goes on behind it among the documents that are no
larger than what is left, until none of them is; a last document that does not fit is taken if that comes nearer.
Documents are taken whole.

Null text has size 0; a document of size 0 is never taken; a null source is a source of its own, last in
order; identical rows share a hash and are taken alike; an empty table gives an empty mix. Input columns
named like a result column are replaced in ``mix``.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, bounded, fresh, materialize, small_table

#: A pattern's row is held by the driver; more of them are refused rather than cut off. Sources that no document
#: links are routed apart from each other, so it is the largest group of linked patterns that takes time.
MOST_PATTERNS = 1_000_000
BITS, LEVEL = 60, 20


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared again by weight."""
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(t for k, t in enumerate(target) if k not in free)
        weight = sum(weights[k] for k in free)
        share = {k: left * weights[k] / weight for k in free}
        full = {k for k in free if share[k] > most * sizes[k]}
        for k in free:
            target[k] = most * sizes[k] if k in full else share[k]
        if not full:
            break
        free -= full
    return target


class Flow:
    """Successive shortest paths with potentials; capacities are integers, costs are not negative."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.room, self.cost = [], [], []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, s: int, t: int) -> int:
        n, sent = len(self.out), 0
        level = [0] * n
        while True:
            far, via = [float("inf")] * n, [-1] * n
            far[s], heap = 0, [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] and (z := d + self.cost[e] + level[x] - level[y]) < far[y]:
                        far[y], via[y] = z, e
                        heapq.heappush(heap, (z, y))
            if via[t] < 0:
                return sent
            level = [v + (d if d < float("inf") else far[t]) for v, d in zip(level, far, strict=True)]
            most, x = None, t
            while x != s:
                most = self.room[via[x]] if most is None else min(most, self.room[via[x]])
                x = self.to[via[x] ^ 1]
            x = t
            while x != s:
                self.room[via[x]] -= most
                self.room[via[x] ^ 1] += most
                x = self.to[via[x] ^ 1]
            sent += most


def linked(patterns: dict[str, tuple[tuple, int]]) -> list[list[str]]:
    """The patterns in groups that share sources, directly or by way of others."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for members, _ in patterns.values():
        for s in members[1:]:
            up[top(s)] = top(members[0])
    groups: dict = {}
    for p, (members, _) in patterns.items():
        groups.setdefault(top(members[0]) if members else ("", p), []).append(p)
    return list(groups.values())


def route(patterns: dict[str, tuple[tuple, int]], quotas: dict, passes: int) -> dict[str, dict]:
    """Tokens from each pattern (its sources and size) to each source, of at most ``passes`` times its size."""
    found: dict[str, dict] = {}
    for group in linked(patterns):
        members = sorted({s for p in group for s in patterns[p][0]}, key=order)
        found |= _route({p: patterns[p] for p in group}, {s: quotas[s] for s in members}, passes)
    return found


def _route(patterns: dict[str, tuple[tuple, int]], quotas: dict, passes: int) -> dict[str, dict]:
    sources = list(quotas)
    at = {s: 2 + len(patterns) + k for k, s in enumerate(sources)}
    net = Flow(2 + len(patterns) + len(sources))
    arcs = {}
    for k, (p, (members, size)) in enumerate(patterns.items()):
        for e in range(1, passes + 1):
            net.arc(0, 2 + k, size, e * e)
        arcs |= {(p, s): net.arc(2 + k, at[s], passes * size, 0) for s in members}
    for s, quota in quotas.items():
        net.arc(at[s], 1, quota, 0)
    net.run(0, 1)
    found: dict[str, dict] = {p: {} for p in patterns}
    for (p, s), a in arcs.items():
        found[p][s] = net.flow(a)
    return found


@dataclass
class Plan:
    """What a mix takes: whole passes, then the documents of some spans of hashes (low, high, largest size) and
    some single ones, by pattern."""

    sizes: dict = field(default_factory=dict)
    targets: dict = field(default_factory=dict)
    routed: dict = field(default_factory=dict)
    passes: dict[str, int] = field(default_factory=dict)
    spans: dict[str, list[tuple[int, int, int]]] = field(default_factory=dict)
    extra: dict[str, list[int]] = field(default_factory=dict)


def _prepared(docs: DataFrame, members: Callable[[], F.Column], text: str, id_: str, seed: int) -> tuple[F.Column, F.Column, F.Column]:
    """The pattern's key, the size, and the seeded hash of a document."""
    key = F.to_json(F.array_sort(F.array_distinct(members())))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return key, size, F.pmod(F.xxhash64(F.lit(seed), F.col(id_), F.col(text)), F.lit(1 << BITS))


def order(source: str | None) -> tuple[bool, str]:
    """Sources by code point, null last."""
    return source is None, source or ""


def plan(rows: DataFrame, quota: Callable[[dict], dict], most: int) -> Plan:
    """rows: key, members, size, hash. quota: sizes of the sources -> their targets."""
    spark = rows.sparkSession
    found = rows.groupBy("key").agg(F.first("members").alias("members"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources")
    patterns = {r["key"]: (tuple(r["members"]), r["size"]) for r in sorted(found, key=lambda r: r["key"])}
    made = Plan()
    for s in sorted({s for members, _ in patterns.values() for s in members}, key=order):
        made.sizes[s] = sum(size for members, size in patterns.values() if s in members)
    made.targets = quota(made.sizes)
    made.routed = route(patterns, {s: round(t) for s, t in made.targets.items()}, most)
    left: dict[str, int] = {}
    for p, (_, size) in patterns.items():
        made.passes[p], left[p] = divmod(sum(made.routed[p].values()), size) if size else (0, 0)
    made.spans = {p: [] for p in patterns}
    made.extra = {p: [] for p in patterns}
    starts = {p: 0 for p, room in left.items() if room}
    while starts:
        rooms = {p: left[p] for p in starts}
        ends, sums = _search(rows, starts, rooms)
        for p, low in starts.items():
            made.spans[p].append((low, ends.get(p, 1 << BITS), rooms[p]))
            left[p] -= sums[p]
        starts = {p: end + 1 for p, end in ends.items() if left[p]}
    open_ = {p: room for p, room in left.items() if room}
    if open_:
        bounds = bounded(small_table(spark, [(p, room, _dicts(made.spans[p])) for p, room in open_.items()], f"key string, room long, __mix_spans {SPANS}"))
        near = rows.join(bounds, "key").filter((F.col("size") > 0) & (F.col("size") < 2 * F.col("room")) & ~_inside(F.col("hash"), F.col("size")))
        whole = near.groupBy("key", "hash").agg(F.sum("size").alias("size"), F.first("room").alias("room")).filter("size < 2 * room")
        for r in whole.groupBy("key").agg(F.min(F.struct("size", "hash")).alias("best")).collect():
            made.extra[r["key"]].append(r["best"]["hash"])
    return made


#: Of the documents with hashes from low to below high, those no larger than most.
SPANS = "array<struct<low:long,high:long,most:long>>"


def _dicts(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [dict(zip(("low", "high", "most"), x, strict=True)) for x in spans]


def _inside(h: F.Column, size: F.Column) -> F.Column:
    return F.exists("__mix_spans", lambda x: (h >= x["low"]) & (h < x["high"]) & (size <= x["most"]))


def _search(rows: DataFrame, starts: dict[str, int], rooms: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
    """From each key's start on, of the documents no larger than its room: the hash at which their running sum passes
    the room, for keys where it does, and the sum before it (for other keys the whole sum)."""
    spark = rows.sparkSession
    fit = lambda x: rows.join(bounded(small_table(spark, x, "key string, low long, start long, room long")), "key").filter((F.col("size") > 0) & (F.col("size") <= F.col("room")) & (F.col("hash") >= F.col("start")))
    open_, sums = dict.fromkeys(starts, 0), dict.fromkeys(starts, 0)
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        inside = fit([(p, low, starts[p], rooms[p]) for p, low in open_.items()]).filter(F.expr(f"shiftright(hash, {shift + LEVEL}) = shiftright(low, {shift + LEVEL})"))
        cells = materialize(inside.groupBy("key", F.expr(f"shiftright(hash, {shift})").alias("bucket")).agg(F.sum("size").alias("size")))
        found = _boundaries(cells, {p: rooms[p] - sums[p] for p in open_})
        if len(found) < len(open_):
            rest = {r["key"]: r["size"] for r in cells.groupBy("key").agg(F.sum("size").alias("size")).collect()}
            for p in open_.keys() - {p for p, _, _ in found}:
                sums[p] += rest.get(p, 0)
        open_ = {p: cell << shift for p, cell, _ in found}
        for p, _, before in found:
            sums[p] += before
        if not open_:
            break
    return open_, sums


def _boundaries(sums: DataFrame, left: dict[str, int]) -> list[tuple[str, int, int]]:
    """The bucket in which each key's running sum passes what is left, and the sum before it."""
    spark = sums.sparkSession
    room = bounded(small_table(spark, list(left.items()), "key string, room long"))
    run = F.expr("sum(size) over (partition by key order by bucket)")
    cells = sums.withColumn("after", run).join(room, "key").filter(F.col("after") > F.col("room"))
    first = cells.groupBy("key").agg(F.min(F.struct("bucket", (F.col("after") - F.col("size")).alias("before"))).alias("b"))
    return [(r["key"], r["b"]["bucket"], r["b"]["before"]) for r in first.collect()]


def _by_weights(weights: tuple[float, ...], share: float, most: int) -> Callable[[dict], dict]:
    def quota(sizes: dict) -> dict:
        names = sorted(sizes, key=order)
        values = [sizes[s] for s in names]
        return dict(zip(names, water_fill(values, [weights[k % len(weights)] for k in range(len(names))], share * sum(values), most), strict=True))

    return quota


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_: str = "doc_id", sources: str | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words that the mix takes, repeats counted).

    A document belongs to ``source``, or to each source in the array column ``sources`` if that is given; then
    source_size and target are sums over its sources. weights repeat over the sources in order; share is that
    of all sizes; no document is taken more than ``most`` times.
    """
    result = ("size", "source_size", "target", "taken")
    members = lambda: F.col(sources) if sources else F.array(F.col(source))
    key, size, h = _prepared(docs, members, text, id_, seed)
    keep = [c for c in docs.columns if c != text and c not in result]
    names = {x: fresh(docs, x) for x in ("key", "members", "hash", "size")}
    held = materialize(docs.select(*keep, key.alias(names["key"]), members().alias(names["members"]), h.alias(names["hash"]), size.alias(names["size"])))
    made = plan(held.select(*[F.col(n).alias(x) for x, n in names.items()]), _by_weights(weights, share, most), most)
    sums = {p: (float(sum(made.targets[s] for s in flows)), sum(made.sizes[s] for s in flows)) for p, flows in made.routed.items()}
    joined = held.join(bounded(_choices(docs, made, sums)), F.col(names["key"]) == F.col("__mix_key"))
    return joined.select(*keep, F.col(names["size"]).alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col(names["size"]) * _copies(F.col(names["hash"]), F.col(names["size"]))).alias("taken"))


def _choices(docs: DataFrame, made: Plan, sums: dict | None = None) -> DataFrame:
    rows = [(p, made.passes[p], _dicts(made.spans[p]), made.extra[p], *((sums or {}).get(p, (0.0, 0)))) for p in made.passes]
    return small_table(docs.sparkSession, rows, f"__mix_key string, __mix_passes long, __mix_spans {SPANS}, __mix_extra array<long>, __mix_target double, __mix_source_size long")


def _copies(h: F.Column, size: F.Column) -> F.Column:
    once_more = _inside(h, size) | F.array_contains("__mix_extra", h)
    return F.when(size > 0, F.col("__mix_passes") + once_more.cast("long")).otherwise(0)


def resample(docs: DataFrame, source: str = "source", text: str = "text", id_: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as it is taken, its columns unchanged. Texts are read twice, never shuffled."""
    members = lambda: F.array(F.col(source))
    key, size, h = _prepared(docs, members, text, id_, seed)
    held = materialize(docs.select(key.alias("key"), members().alias("members"), h.alias("hash"), size.alias("size")))
    made = plan(held, _by_weights(weights, share, most), most)
    columns, names = docs.columns, {x: fresh(docs, x) for x in ("key", "hash", "size", "copy")}
    more = docs.withColumns({names["key"]: key, names["hash"]: h, names["size"]: size})
    joined = more.join(bounded(_choices(docs, made)), F.col(names["key"]) == F.col("__mix_key"))
    copies = _copies(F.col(names["hash"]), F.col(names["size"])).cast("int")
    return joined.filter(copies > 0).select(*[F.col(c) for c in columns], F.explode(F.sequence(F.lit(1), copies)).alias(names["copy"])).select(*columns)
