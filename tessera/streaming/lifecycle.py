"""The lifecycle of documents as a stateful stream of events, and its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import schema as S

# The steps that may follow each state; any state may fail or be cancelled.
NEXT = {
    None: ("queued",),
    "queued": ("extracting", "enriching"),
    "extracting": ("parsing",),
    "parsing": ("extracted",),
    "extracted": ("enriching", "indexing", "queued"),
    "enriching": ("indexing", "extracted"),
    "indexing": ("done",),
    "done": ("queued",),
    "error": ("queued",),
    "cancelled": ("queued",),
}


def allowed(old: str | None, new: str) -> bool:
    return new in ("error", "cancelled") if old in S.RESUMABLE and new in ("error", "cancelled") else new in NEXT.get(old, ())


def may_follow(old: Column, new: Column) -> Column:
    """``allowed`` as an expression. Null is the state before the first one."""
    pairs = [f"{a or ''}>{b}" for a in NEXT for b in S.STATUSES if allowed(a, b)]
    return F.concat(F.coalesce(old, F.lit("")), F.lit(">"), new).isin(*pairs)


def latest(events: DataFrame) -> DataFrame:
    """events: doc_id, ts, status -> each document's last state; ties go to the larger event_id."""
    return events.groupBy("doc_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"), F.count("*").alias("events"))


def followed(events: DataFrame) -> DataFrame:
    """events: doc_id, ts, event_id, status -> doc_id, status, refused: the state after the allowed changes in order, and
    how many were refused. The first event that is seen of a document is taken as it is."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "status"))), lambda e: e["status"])
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("refused"))

    def step(held: Column, new: Column) -> Column:
        ok = held["status"].isNull() | may_follow(held["status"], new)
        return F.struct(F.when(ok, new).otherwise(held["status"]).alias("status"), (held["refused"] + F.when(ok, 0).otherwise(1)).cast("long").alias("refused"))

    return events.groupBy("doc_id").agg(F.aggregate(listed, start, step).alias("x")).select("doc_id", "x.*")


def transitions(events: DataFrame) -> DataFrame:
    """from_status, to_status, n over each document's events in order."""
    order = Window.partitionBy("doc_id").orderBy("ts", "event_id")
    return events.withColumn("from_status", F.lag("status").over(order)).groupBy("from_status", F.col("status").alias("to_status")).agg(F.count("*").alias("n"))


def resume_candidates(states: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents cut off in a run: doc_id, phase: enrich if their chunks are stored, else parse."""
    stored = chunks.select("doc_id").distinct().withColumn("stored", F.lit(True))
    return states.filter(F.col("status").isin(*S.RESUMABLE)).join(stored, "doc_id", "left").select("doc_id", F.when(F.col("stored"), "enrich").otherwise("parse").alias("phase"))


def track(events: DataFrame, forget: int | None = None) -> DataFrame:
    """A stream of doc_id, ts, event_id, status as doc_id, status, events: the state after each batch.

    forget, for streams that run on: milliseconds of processing time after which a document without events is forgotten.
    A stream that is to stop at the end of what is there needs None, as waiting for such a time never ends.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ts, event, status, n = state.get if state.exists else (0, -1, None, 0)
        for f in frames:
            n += len(f)
            at = pd.DataFrame({"ts": f["ts"].astype("datetime64[ns]").astype("int64"), "event": f["event_id"].astype("int64")})
            k = at.sort_values(["ts", "event"]).index[-1]
            if (last := (int(at["ts"][k]), int(at["event"][k]))) > (ts, event):
                (ts, event), status = last, f["status"][k]
        state.update((ts, event, status, n))
        if forget:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame({"doc_id": [key[0]], "status": [status], "events": [n]})

    return events.groupBy("doc_id").applyInPandasWithState(step, "doc_id string, status string, events long", "ts long, event long, status string, n long", "update", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
