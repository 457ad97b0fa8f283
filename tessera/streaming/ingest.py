"""Incremental ingestion: files to chunks to postings, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import chunking, enrich, outline, store
from tessera.sources import extract
from tessera.storage import checkpointed
from tessera.streaming import states


def documents_of(files: DataFrame) -> DataFrame:
    """files: doc_id, name, mime, content -> doc_id, text, pages, outline, outline_source, warning.

    Pages lose recurring edge lines. The outline is the file's bookmarks, else the headings found in its text.
    """
    rows = checkpointed(extract.extract(files))
    paged = rows.filter(F.size("pages") > 0)
    split = paged.select("doc_id", F.transform("pages", lambda p: F.split(p, "\n", -1)).alias("pages"))
    clean = outline.strip_furniture(split).select("doc_id", F.transform("pages", lambda p: F.array_join(p, "\n")).alias("clean"))
    marked = extract.flatten_bookmarks(rows.filter("bookmarks is not null")).select("doc_id", F.col("outline").alias("marked"))
    entry = F.struct(F.col("level"), F.col("title"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<string>").alias("path"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("e")))), lambda x: x["e"])
    found = outline.detect_outline(rows.filter("bookmarks is null")).groupBy("doc_id").agg(listed.alias("found"))
    rows = rows.join(clean, "doc_id", "left").join(marked, "doc_id", "left").join(found, "doc_id", "left")
    source = F.when(F.size("marked") > 0, "pdf-bookmarks").when(F.size("found") > 0, "text-headings")
    entries = F.when(F.size("marked") > 0, F.col("marked")).otherwise(F.col("found"))
    text = F.when(F.size("clean") > 0, X.trim(F.array_join("clean", "\n\n"))).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), F.coalesce("clean", "pages").alias("pages"), outline.normalize_outline(entries).alias("outline"), source.alias("outline_source"), "warning")


def newest(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: the one uploaded last, then the one with the larger digest of its bytes."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("uploaded_at"), F.desc(F.sha2("content", 256)), F.desc("name"))
    return rows.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")


def take(rows: DataFrame, tables: store.Tables, enricher: enrich.Enricher | None = None) -> None:
    """Writes accepted files to docs, chunks and the index; doing it again changes nothing.

    Only these documents are chunked, enriched and cut into tokens, only their buckets are rewritten, and the index gets
    one segment of them.
    """
    rows = checkpointed(newest(rows))
    if not rows.limit(1).count():
        return
    made = checkpointed(documents_of(rows))
    new = chunking.build_chunks(made)
    new = checkpointed(enrich.enrich(new, enricher) if enricher else new)
    ids = rows.select("doc_id")
    tables.put_chunks(new, ids)
    docs = rows.select("doc_id", "name", "mime", "size", "uploaded_at").join(made.select("doc_id", "outline", "outline_source", "warning"), "doc_id")
    docs = docs.withColumn("status", F.lit("done")).withColumn("progress", F.lit(100))
    for f in S.DOCS:
        if f.name not in docs.columns:
            docs = docs.withColumn(f.name, F.lit(None).cast(f.dataType))
    docs = checkpointed(docs.filter("doc_id != ''"))
    tables.change("docs", S.DOCS, lambda _: docs, ids)
    tables.tidy()


def ingest(files: DataFrame, tables: store.Tables, checkpoint: str, enricher: enrich.Enricher | None = None, seconds: int | None = 20) -> StreamingQuery:
    """``take`` for a stream of files, batch by batch; a file that is offered again unchanged is not taken again. seconds is the least time between batches; None takes what is
    there and stops."""
    accepted, _ = extract.uploads(states.offered_once(files, keys=("doc_id", "uploaded_at")))
    writer = accepted.writeStream.foreachBatch(lambda rows, _: take(rows, tables, enricher)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def file_stream(spark: SparkSession, path: str, most_files: int = 200) -> DataFrame:
    """New files under a path, at most so many a batch, as doc_id, name, declared, content, size, uploaded_at."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    f = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").load(path)
    return f.select(F.sha1("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("name"), F.lit(None).cast("string").alias("declared"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("uploaded_at"))


def counted(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Counts of a stream's events by type in a memory table, over what is there."""
    out = events.groupBy("event_type").agg(F.count("*").alias("events"))
    return out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
