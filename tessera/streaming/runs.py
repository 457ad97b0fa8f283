"""Enrichment runs over the stored tables: in batches until nothing is left, with a breaker, cancelling and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.operators import enrich, store
from tessera.storage import checkpointed
from tessera.streaming import lifecycle

# The note of an unfinished run, and the error of a batch without a result.
NOTE = "增强未完成："
NO_RESULT = "一批 LLM 增强全部失败，仍有片段未增强；可稍后重试"


def _has(summary: str = "summary") -> Column:
    return F.coalesce(summary, F.lit("")) != ""


def patch_docs(tables: store.Tables, rows: DataFrame) -> None:
    """rows: doc_id and columns of documents -> the documents with these values in place of their own.

    A change of status that the lifecycle does not allow leaves the status as it is.
    """
    rows = checkpointed(rows)
    names = {c: f"__new_{c}" for c in rows.columns if c != "doc_id"}
    found = rows.select("doc_id", F.lit(True).alias("__hit"), *[F.col(c).alias(n) for c, n in names.items()])

    def change(docs: DataFrame) -> DataFrame:
        both = docs.join(found, "doc_id", "left")

        def value(c: str) -> Column:
            if c not in names:
                return F.col(c)
            hit = F.col("__hit")
            if c == "status":
                hit = hit & lifecycle.may_follow(F.col(c), F.col(names[c]))
            return F.when(hit, F.col(names[c])).otherwise(F.col(c)).alias(c)

        return both.select([value(f.name) for f in S.DOCS])

    tables.change("docs", S.DOCS, change, rows.select("doc_id"))


def cancel(tables: store.Tables, doc_ids: DataFrame) -> None:
    """Documents that are queued or being worked on stop: a run takes none of their chunks from its next batch on."""
    active = tables.read("docs", S.DOCS).filter(F.col("status").isin(*S.RESUMABLE)).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    patch_docs(tables, active.select("doc_id", F.lit("cancelled").alias("status")))


def resume(tables: store.Tables) -> DataFrame:
    """doc_id, phase of documents that were cut off in a run; they are queued again."""
    docs = tables.read("docs", S.DOCS)
    found = checkpointed(lifecycle.resume_candidates(docs.select("doc_id", "status"), tables.read("chunks", S.CHUNKS)))
    if found.limit(1).count():
        again = docs.filter("status != 'queued'").join(found, "doc_id", "left_semi").select("doc_id", F.lit("error").alias("status"))
        patch_docs(tables, again)
        patch_docs(tables, found.select("doc_id", F.lit("queued").alias("status"), F.lit(0).alias("progress"), F.lit(None).cast("string").alias("error")))
    return found


def _waiting(tables: store.Tables) -> DataFrame:
    """The chunks of documents in a run that have some without a summary."""
    active = tables.read("docs", S.DOCS).filter("status = 'enriching'").select("doc_id")
    chunks = tables.read("chunks", S.CHUNKS).join(active, "doc_id", "left_semi")
    return chunks.join(chunks.filter(~_has()).select("doc_id").distinct(), "doc_id", "left_semi")


def run(tables: store.Tables, enricher: enrich.Enricher, budget: int = 400, parallel: int | None = None, doc_ids: DataFrame | None = None) -> int:
    """Enriches all documents (those of doc_ids) in batches of at most ``budget`` chunks each, and returns their number.

    What a batch gains is stored before the next one. A document of which a batch gains nothing is taken out of the
    run, with an error; one that is cancelled meanwhile is taken out too. At the end documents are done, with a summary
    of their first chunks' summaries and a note if some chunks have none.
    """
    docs = tables.read("docs", S.DOCS).filter(F.col("status").isin("extracted", "queued", "enriching", "done", "error"))
    docs = docs if doc_ids is None else docs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    open_ = tables.read("chunks", S.CHUNKS).filter(~_has()).select("doc_id").distinct()
    begun = checkpointed(docs.join(open_, "doc_id", "left_semi").select("doc_id", "status"))
    patch_docs(tables, begun.filter("status in ('done', 'error')").select("doc_id", F.lit("queued").alias("status")))
    patch_docs(tables, begun.select("doc_id", F.lit("enriching").alias("status"), F.lit(None).cast("string").alias("error")))
    batches, stuck = 0, begun.limit(0).select("doc_id")
    while True:
        mine = _waiting(tables).join(stuck, "doc_id", "left_anti")
        if not mine.limit(1).count():
            break
        batches += 1
        mine = checkpointed(mine)
        new = checkpointed(enrich.enrich(mine, enricher, budget, parallel))
        n = lambda rows, name: rows.groupBy("doc_id").agg(F.count_if(_has()).alias(name))
        idle = n(mine, "before").join(n(new, "after"), "doc_id").filter("after = before").select("doc_id")
        stuck = checkpointed(stuck.unionByName(idle))
        tables.patch_chunks(new)
        patch_docs(tables, enrich.coverage(new).select("doc_id", "progress"))
    _finish(tables, begun, stuck)
    tables.tidy()
    return batches


def _finish(tables: store.Tables, begun: DataFrame, stuck: DataFrame) -> None:
    docs = tables.read("docs", S.DOCS).filter("status = 'enriching'").join(begun.select("doc_id"), "doc_id", "left_semi")
    chunks = tables.read("chunks", S.CHUNKS).join(docs.select("doc_id"), "doc_id", "left_semi")
    made = docs.select("doc_id", "warning", F.col("summary").alias("old")).join(enrich.coverage(chunks).drop("progress"), "doc_id", "left").join(enrich.document_summary(chunks), "doc_id", "left").join(stuck.distinct().withColumn("stuck", F.lit(True)), "doc_id", "left")
    kept = F.filter(F.transform(F.split(F.coalesce("warning", F.lit("")), "；", -1), F.trim), lambda x: (x != "") & ~x.startswith(NOTE))
    note = F.format_string(NOTE + "%d/%d 个片段已有小结（覆盖 %d/%d 个章节），其余保留本地大纲", "enhanced", "chunks", "covered", "sections")
    warning = F.array_join(F.concat(kept, F.when(F.col("enhanced") < F.col("chunks"), F.array(note)).otherwise(F.array().cast("array<string>"))), "；")
    rows = checkpointed(made.select("doc_id", F.when(warning != "", warning).alias("warning"), F.coalesce("summary", "old").alias("summary"), F.when(F.col("stuck"), NO_RESULT).alias("error"), F.lit("indexing").alias("status")))
    patch_docs(tables, rows)
    patch_docs(tables, rows.select("doc_id", F.lit("done").alias("status"), F.lit(100).alias("progress")))
