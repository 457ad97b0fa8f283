"""Streams with state on rows out of order, late, repeated and unfinished."""

import datetime
import os

import pandas as pd
from pyspark.sql import functions as F

from tessera.plans import streams
from tessera.streaming import states


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def batches(spark, path, schema, *parts):
    """A stream that gives each part in a batch of its own."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        newest = max((path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


EVENTS = "doc_id string, ts timestamp, event_id long, status string, command string"


def test_commands_stop_and_late_rows_change_nothing(spark, tmp_path):
    first = [("a", at(0), 1, "queued", None), ("a", at(2), 3, "extracting", None), ("b", at(0), 2, "queued", None), ("c", at(0), 4, None, "cancel"), (None, at(0), 5, "queued", None)]
    second = [("a", at(3), 6, None, "cancel"), ("a", at(4), 7, "parsing", None), ("b", at(-5), 8, "extracting", None), ("c", at(1), 9, "queued", None), ("b", at(9), 10, None, "unknown")]
    third = [("a", at(5), 11, None, "retry"), ("a", at(6), 12, "extracting", None), ("b", at(9), 13, "extracting", None)]
    rows = batches(spark, tmp_path, EVENTS, first, second, third)
    out = states.run_now(states.lifecycles(rows.filter("command is null"), rows.filter("command is not null")), str(tmp_path / "out"), "update")
    got = {(r.doc_id, r.batch): (r.status, r.events, r.refused) for r in out.collect()}
    assert got[("a", 0)] == ("extracting", 2, 0) and got[("a", 1)] == ("cancelled", 4, 1) and got[("a", 2)] == ("extracting", 6, 1)
    assert got[("b", 1)] == ("queued", 3, 2) and got[("b", 2)] == ("extracting", 4, 2)
    assert got[("c", 0)] == (None, 1, 1) and got[("c", 1)] == ("queued", 2, 1) and got[(None, 0)] == ("queued", 1, 0)


def test_answers_grow_in_order(spark, tmp_path):
    schema = "answer_id string, seq long, delta string, last boolean"
    first = [("x", 2, "c", True), ("x", 0, "a", False), ("y", 0, "never ", False), ("z", 1, "lost", True)]
    second = [("x", 1, None, False), ("y", 1, "ends", False), ("y", 1, "other", False)]
    third = [("x", 3, "late", False), ("x", 0, "again", False)]
    out = states.run_now(states.answers(batches(spark, tmp_path, schema, first, second, third)), str(tmp_path / "out"), "update")
    got = {(r.answer_id, r.batch): (r.text, r.parts, r.waiting, r.finished) for r in out.collect()}
    assert got == {("x", 0): ("a", 1, 1, False), ("y", 0): ("never ", 1, 0, False), ("z", 0): ("", 0, 1, False), ("x", 1): ("ac", 3, 0, True), ("y", 1): ("never ends", 2, 0, False)}


def test_files_are_taken_once_and_late_ones_left_out(spark, tmp_path):
    schema = "doc_id string, content binary, uploaded_at timestamp"
    first = [("a", b"1", at(0)), ("a", b"1", at(1)), ("b", None, at(0))]
    second = [("a", b"1", at(5)), ("a", b"2", at(600)), ("b", b"", at(6))]
    third, fourth = [("d", b"4", at(590))], [("c", b"3", at(10)), ("a", b"2", at(601))]
    out = states.run_now(states.offered_once(batches(spark, tmp_path, schema, first, second, third, fourth), "1 hour"), str(tmp_path / "out"))
    assert sorted((r.doc_id, bytes(r.content or b""), r.batch) for r in out.filter("doc_id is not null").collect())[:3] == [("a", b"1", 0), ("a", b"2", 1), ("b", b"", 0)]
    assert {r.doc_id for r in out.collect()} == {"a", "b", "d"}  # c is more than an hour older than what was there


def test_pairs_of_two_streams(spark, tmp_path):
    schema = "doc_id string, event_id long, ts timestamp"
    left = batches(spark, tmp_path / "l", schema, [("a", 1, at(0)), ("b", 2, at(0)), (None, 9, at(0))], [("a", 3, at(50))])
    right = batches(spark, tmp_path / "r", schema, [("a", 4, at(0)), ("b", 5, at(61)), (None, 6, at(0))], [("a", 7, at(60)), ("a", 8, at(-1))])
    out = states.run_now(states.paired(left, right), str(tmp_path / "out"))
    assert {(r.doc_id, r.left_id, r.right_id) for r in out.collect()} == {("a", 1, 4), ("a", 1, 7), ("a", 3, 7)}
    assert out.filter(F.col("doc_id").isNull()).count() == 0


def test_documents_share_states_in_groups(spark, tmp_path):
    """60 documents in 4 groups keep 4 states, and each document its own status."""
    first = [(f"d{k}", at(k), k, "queued" if k % 2 else "done", None) for k in range(60)]
    second = [(f"d{k}", at(k + 100), k + 100, "extracting", None) for k in range(60)]
    out = states.lifecycles(batches(spark, tmp_path, EVENTS, first, second), groups=4)
    query = out.writeStream.outputMode("update").format("memory").queryName("grouped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    got = {r.doc_id: (r.status, r.refused) for r in spark.table("grouped").filter("events = 2").collect()}
    assert got == {f"d{k}": ("extracting", 0) if k % 2 else ("done", 1) for k in range(60)}


def test_documents_of_a_group_are_forgotten_one_by_one():
    """A group's timer forgets the documents that had no rows for that long, and waits on for the others."""

    class State:
        exists, hasTimedOut, get, now, wait = False, False, None, 1000, None

        def getCurrentProcessingTimeMs(self):
            return self.now

        def update(self, new):
            self.exists, self.get = True, new

        def setTimeoutDuration(self, wait):
            self.wait = wait

        def remove(self):
            self.exists = False

    def rows(*of):
        return iter([pd.DataFrame(of, columns=["doc_id", "t", "event_id", "change"])])

    state, step = State(), states._follow(500)
    list(step((0,), rows(("a", 1, 1, "queued"), ("b", 1, 2, "queued")), state))
    state.now = 1300
    out = pd.concat(step((0,), rows(("b", 2, 3, "extracting")), state))
    assert out.to_numpy().tolist() == [["b", "extracting", 2, 0]] and state.wait == 200
    state.now, state.hasTimedOut = 1500, True
    assert not sum(map(len, step((0,), iter([]), state)))
    assert state.exists and state.wait == 300 and '"a"' not in state.get[0] and '"b"' in state.get[0]
    state.now = 1800
    list(step((0,), iter([]), state))
    assert not state.exists


def test_large_batches_are_written_by_several_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(streams, "ROWS_OF_FILE", 500)
    table = spark.range(4000).select("id", (F.col("id") >= 1500).cast("int").alias("__file"))
    monkeypatch.setattr(streams, "new_path", lambda spark, stem: str(tmp_path / stem))
    out = states.run_now(streams._stream(spark, table), str(tmp_path / "out"))
    assert len(list((tmp_path / "stream" / "files").glob("*.parquet"))) > 2
    assert {(r.batch, r.least, r.n) for r in out.groupBy("batch").agg(F.min("id").alias("least"), F.count("*").alias("n")).collect()} == {(0, 0, 1500), (1, 1500, 2500)}
