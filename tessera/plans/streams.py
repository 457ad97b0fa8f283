"""Queries over streams with state; each equals SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.plans import base as P
from tessera.plans.catalogue import query
from tessera.plans.more import _ALLOWED
from tessera.storage import new_path
from tessera.streaming import states


#: Rows of each batch of a stream from which these are written by several tasks.
ROWS_OF_FILE = 100_000


def _stream(spark: SparkSession, table: DataFrame, files: int = 2) -> DataFrame:
    """A stream of a table's rows, dealt by order into batches, each of which takes as many files."""
    path = new_path(spark, "stream")
    table.write.parquet(f"{path}/whole")
    whole = spark.read.schema(table.schema).parquet(f"{path}/whole")
    sizes = whole.agg(*[F.count_if(F.col("__file") == k) for k in range(files)]).first()
    # Where rows are few some task would have none, and write no file.
    each = 1 if min(sizes) < ROWS_OF_FILE else min(spark.sparkContext.defaultParallelism, -(-max(sizes) // ROWS_OF_FILE))
    for k in range(files):
        part = whole.filter(F.col("__file") == k).drop("__file")
        (part.coalesce(1) if each == 1 else part.repartition(each)).write.mode("append").parquet(f"{path}/files")
    return spark.readStream.schema(whole.drop("__file").schema).option("maxFilesPerTrigger", each).parquet(f"{path}/files")


def _last(rows: DataFrame, key: str) -> DataFrame:
    """The row of the last batch of each key."""
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("x")).select(key, "x.*")



_COMMANDS = "event_id % 11 = 0"


@query(
    "stream_lifecycles",
    f"""WITH RECURSIVE {P.STATUS}, c AS (SELECT doc_id, ts, event_id, CASE WHEN event_id % 22 = 0 THEN 'cancel' WHEN {_COMMANDS} THEN 'retry' END AS command, CASE WHEN event_id % 22 = 0 THEN 'cancelled' WHEN {_COMMANDS} THEN 'queued' ELSE status END AS status FROM se),
    l AS (SELECT doc_id, list(status ORDER BY ts, event_id) AS ss, list(command ORDER BY ts, event_id) AS cs FROM c GROUP BY doc_id),
    r AS (SELECT doc_id, ss, cs, 0 AS i, CAST(NULL AS VARCHAR) AS status, 0 AS refused FROM l
      UNION ALL SELECT doc_id, ss, cs, i + 1, CASE WHEN ok THEN ss[i + 1] ELSE status END, refused + CASE WHEN ok THEN 0 ELSE 1 END
      FROM (SELECT *, CASE WHEN cs[i + 1] = 'cancel' THEN coalesce(status, '') IN ({", ".join(f"'{s}'" for s in S.RESUMABLE)}) ELSE i = 0 OR coalesce(status, '') || '>' || ss[i + 1] IN ({_ALLOWED}) END AS ok FROM r WHERE i < len(ss)))
    SELECT doc_id, status, CAST(len(ss) AS BIGINT) AS events, CAST(refused AS BIGINT) AS refused FROM r WHERE i = len(ss)""",
)
def _(spark, sf):
    """Events and commands in order of time, in two batches."""
    e = P.status_events(spark, sf)
    middle = e.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5, 100_000)).first()[0] or 0
    placed = e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("__file", (F.unix_micros("ts") > middle).cast("int"))
    rows = _stream(spark, placed)
    told = F.col("event_id") % 11 == 0
    commands = rows.filter(told).select("doc_id", "ts", "event_id", F.when(F.col("event_id") % 22 == 0, "cancel").otherwise("retry").alias("command"))
    out = states.run_now(states.lifecycles(rows.filter(~told), commands), new_path(spark, "lifecycles"), "update")
    return _last(out, "doc_id")


_OPEN = "conv_id % 7 = 3"


@query(
    "stream_answers",
    f"""WITH d AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AND NOT ({_OPEN}) AS last FROM conversations),
    g AS (SELECT conv_id, turn, text, last, turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS in_row FROM d WHERE NOT ({_OPEN} AND turn = 2))
    SELECT CAST(conv_id AS VARCHAR) AS answer_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (in_row), '') AS text, count(*) FILTER (in_row) AS parts, count(*) FILTER (NOT in_row) AS waiting, bool_or(last AND in_row) AS finished FROM g GROUP BY conv_id""",
)
def _(spark, sf):
    """Turns as parts of answers: the later ones come first; some answers never end and lack a part."""
    c = P.table(spark, sf, "conversations")
    open_ = F.col("conv_id") % 7 == 3
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("end"))
    rows = c.join(ends, "conv_id").filter(~(open_ & (F.col("turn") == 2)))
    parts = rows.select(F.col("conv_id").cast("string").alias("answer_id"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("delta"), ((F.col("turn") == F.col("end")) & ~open_).alias("last"), (F.col("turn") % 2 == 0).cast("int").alias("__file"))
    return _last(states.run_now(states.answers(_stream(spark, parts)), new_path(spark, "answers"), "update"), "answer_id")


@query("stream_offered_once", "SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS content, min(event_id % 2) AS first_batch FROM events GROUP BY ALL")
def _(spark, sf):
    """Files that are offered in two batches and again within one."""
    e = P.table(spark, sf, "events")
    files = e.select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("content"), F.col("ts").cast("timestamp").alias("uploaded_at"), (F.col("event_id") % 2).alias("parity"), (F.col("event_id") % 2).cast("int").alias("__file"))
    out = states.run_now(states.offered_once(_stream(spark, files), "60 days"), new_path(spark, "once"))
    return out.select("doc_id", "content", F.col("parity").alias("first_batch"))


@query("stream_paired_events", "SELECT CAST(v.user_id AS VARCHAR) AS doc_id, v.event_id AS left_id, p.event_id AS right_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOURS")
def _(spark, sf):
    """Purchases within six hours of a view, as a join of two streams."""
    e = P.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("doc_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    middle = e.agg(F.percentile_approx(F.unix_micros("ts"), 0.5, 100_000)).first()[0] or 0
    placed = e.withColumn("__file", (F.unix_micros("ts") > middle).cast("int"))
    views, buys = (_stream(spark, placed.filter(F.col("event_type") == kind)).drop("event_type") for kind in ("view", "purchase"))
    return states.run_now(states.paired(views, buys, "6 HOURS", "12 hours"), new_path(spark, "paired")).drop("batch")
