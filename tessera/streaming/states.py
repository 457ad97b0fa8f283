"""Streams with state: lifecycles with commands, answers that arrive in parts, files offered again, events that belong together."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera import schema as S
from tessera.streaming import lifecycle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, off the heap, which ``transformWithState`` needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


#: What commands set; a change that a command asks for is marked, to be told from a status.
COMMANDS = {"cancel": "cancelled", "retry": "queued"}
_TOLD = "!"


#: Groups of documents, by a hash, whose states are one value each: a call into Python costs milliseconds, whatever it holds.
GROUPS = 2048


def _follow(forget: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of ``lifecycles`` for a group of documents: its rows of a batch, as doc_id, t (microseconds), event_id, change.

    The state is a list in JSON: doc_id, status, t and event_id of the latest row, events, refused, time of processing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if forget else 0
        held = {x[0]: x[1:] for x in json.loads(state.get[0])} if state.exists else {}
        if forget:
            held = {k: x for k, x in held.items() if x[-1] + forget > now}
        changed = {}
        if not state.hasTimedOut:
            rows = [x for f in frames for x in zip(*(f[c].tolist() for c in ("t", "event_id", "doc_id", "change")), strict=True)]
            for t, e, doc, change in sorted(rows, key=lambda x: x[:2]):
                doc = doc if isinstance(doc, str) else None
                status, ts, event, n, refused, _ = held.get(doc) or (None, -(1 << 62), -1, 0, 0, 0)
                told = isinstance(change, str) and change.startswith(_TOLD)
                new = COMMANDS.get(change[len(_TOLD) :]) if told else change if isinstance(change, str) else None
                ok = (t, e) > (ts, event) and new is not None
                if ok and told and new == "cancelled":
                    ok = status in S.RESUMABLE
                elif ok and n:
                    ok = lifecycle.allowed(status, new)
                held[doc] = changed[doc] = (new if ok else status, *max((ts, event), (t, e)), n + 1, refused + (not ok), now)
        if held:
            state.update((json.dumps([(k, *x) for k, x in held.items()]),))
            if forget:
                state.setTimeoutDuration(max(1, min(x[-1] for x in held.values()) + forget - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(k, x[0], x[3], x[4]) for k, x in changed.items()], columns=["doc_id", "status", "events", "refused"])

    return step


def lifecycles(events: DataFrame, commands: DataFrame | None = None, forget: int | None = None, groups: int = GROUPS) -> DataFrame:
    """events: doc_id, ts, event_id, status; commands: doc_id, ts, event_id, command -> doc_id, status, events, refused.

    A document's state is changed by the events and commands that may follow it. Rows of a batch are taken by time, then
    by event_id. A row that is older than what was taken before is late: it changes nothing and counts as refused, as does
    a change that is not allowed. ``cancel`` stops what is queued or being worked on, ``retry`` queues what failed, was
    cancelled or is done; both are refused else. ``forget``: milliseconds of processing time without rows after which a
    document is forgotten.

    Both may be streams; a document's row is sent anew whenever rows of it have come. Documents are followed in ``groups``
    groups by a hash of their id, so that a batch costs as many calls into Python at most; a checkpoint keeps its number.
    A group's states are read and written together, so that number should be some thousandth of the documents at least.
    A stream that is to stop at the end of what is there needs no ``forget``, as waiting for its timers never ends.
    """
    place = ("doc_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 63))).alias("t"), F.col("event_id").cast("long").alias("event_id"))
    rows = events.select(*place, F.col("status").alias("change"))
    if commands is not None:
        rows = rows.unionByName(commands.select(*place, F.concat(F.lit(_TOLD), "command").alias("change")))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    keyed = rows.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    return keyed.groupBy("group").applyInPandasWithState(_follow(forget), "doc_id string, status string, events long, refused long", "held string", "update", timeout)


class Answers(StatefulProcessor):
    """An answer as a list of its parts, which grows until the part that is marked as the last, and all before it, have come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "seq long, delta string, last boolean")
        self.done = handle.getValueState("done", "finished boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        if self.done.exists():
            return  # parts behind the end change nothing
        new = [(int(s), d if isinstance(d, str) else "", bool(e)) for s, d, e in zip(every["seq"], every["delta"], every["last"], strict=True)]
        self.parts.appendList(new)
        known: dict[int, tuple[str, bool]] = {}
        for seq, delta, last in sorted((tuple(x) for x in self.parts.get()), key=lambda x: (x[0], x[1])):
            known.setdefault(seq, (delta, last))  # of parts with one number the least text counts
        text, finished, n = [], False, 0
        while n in known and not finished:
            delta, finished = known[n]
            text.append(delta)
            n += 1
        if finished:
            self.done.update((True,))
            self.parts.clear()
        yield pd.DataFrame({"answer_id": [key[0]], "text": ["".join(text)], "parts": [n], "waiting": [0 if finished else len(known) - n], "finished": [finished]})

    def close(self) -> None:
        pass


def answers(deltas: DataFrame) -> DataFrame:
    """deltas: answer_id (string), seq (from 0), delta, last -> answer_id, text, parts, waiting, finished, a row for each batch that has parts.

    text joins the parts from the first to the first gap; waiting counts those behind it. A finished answer keeps no
    parts in state and takes no more. Start it within ``rocks``.
    """
    return deltas.groupBy("answer_id").transformWithStateInPandas(Answers(), "answer_id string, text string, parts long, waiting long, finished boolean", "Update", "None")


def offered_once(files: DataFrame, delay: str = "1 day", keys: tuple[str, ...] = ("doc_id",), time: str = "uploaded_at") -> DataFrame:
    """A stream of files (doc_id, content, uploaded_at, ...) without those whose bytes were offered under their keys before.

    Keys and digests are kept in state until uploads are ``delay`` newer; a file that is older than that is too late and left out.
    """
    marked = files.withColumn("__digest", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256))
    return marked.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, "__digest"]).drop("__digest")


def paired(left: DataFrame, right: DataFrame, within: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Streams of doc_id, event_id, ts -> doc_id, left_id, right_id of rows of one document, right at most ``within`` after left.

    Both sides have a watermark, so that rows leave the state when no partner can come; later rows than that are left out.
    """
    a = left.select("doc_id", F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts")).withWatermark("left_ts", delay)
    b = right.select(F.col("doc_id").alias("right_doc"), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts")).withWatermark("right_ts", delay)
    near = F.expr(f"doc_id = right_doc AND right_ts >= left_ts AND right_ts <= left_ts + INTERVAL {within}")
    return a.join(b, near).select("doc_id", "left_id", "right_id")


def run_now(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a stream gives over what is there, with a column ``batch``, stored under ``path``."""
    spark = stream.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/rows/part={batch}")

    with rocks(spark):
        query: StreamingQuery = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("part")
