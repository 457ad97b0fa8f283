"""Enrichment of chunks by a scorer outside, with a deterministic stand-in."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators.outline import group_sections

#: Characters of a chunk that a scorer sees.
SEEN = 4000


class Enricher(Protocol):
    """Made on the driver and sent to tasks; returns summary, entities and relations, or a reply in JSON with these, or None."""

    def __call__(self, title: str, text: str) -> tuple[str, list[str], list[str]] | str | None: ...


class FirstSentence:
    """The stand-in: a chunk's first sentence, no entities and no relations."""

    def __call__(self, title: str, text: str) -> tuple[str, list[str], list[str]] | None:
        flat = " ".join(text.split())
        m = re.match(X.SENTENCE, flat)
        s, most = m[0] if m else flat, X.SENTENCE_LENGTH
        return (s if len(s) <= most else s[: most - 1].rstrip() + "…", [], []) if s else None


class Retrying:
    """An enricher that asks another one again, after waits that double, when it raises; its last error is raised."""

    def __init__(self, enricher: Enricher, tries: int = 3, wait: float = 0.5):
        self.enricher, self.tries, self.wait = enricher, tries, wait

    def __call__(self, title: str, text: str) -> tuple[str, list[str], list[str]] | str | None:
        for k in range(self.tries - 1):
            try:
                return self.enricher(title, text)
            except Exception:  # whatever a backend may raise
                time.sleep(self.wait * 2**k)
        return self.enricher(title, text)


def parse_reply(reply: str | Column) -> Column:
    """A reply in JSON, with or without a code fence, as struct summary, entities, relations; null if it is no JSON, or null.

    A summary that is no string is empty; entries of lists that are no strings are left out, and what is no list is an
    empty one. A reply that repeats a name is no JSON here.
    """
    r = F.col(reply) if isinstance(reply, str) else reply
    inner = X.trim(F.regexp_replace(F.regexp_replace(r, "^(?i)```(?:json)?", ""), "```$", ""))
    v = F.try_parse_json(inner)
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))

    def strings(name: str) -> Column:
        items = F.try_variant_get(v, f"$.{name}", "array<variant>")
        kept = F.transform(F.filter(items, lambda x: kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
        return F.coalesce(kept, F.array().cast("array<string>"))

    told = F.try_variant_get(v, "$.summary", "variant")
    summary = F.when(kind(told) == "STRING", F.try_variant_get(v, "$.summary", "string")).otherwise(F.lit(""))
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.struct(summary.alias("summary"), strings("entities").alias("entities"), strings("relations").alias("relations")))


def select_targets(chunks: DataFrame, budget: int) -> DataFrame:
    """The chunks that are enriched first: every section's opening one, then in turn, until each document's budget.

    A budget of 0 or less, or one that a document does not exceed, takes all of it.
    """
    if budget <= 0:
        return chunks
    rows = group_sections(chunks)
    turn = F.row_number().over(Window.partitionBy("doc_id", "section_no").orderBy("chunk_index"))
    order = Window.partitionBy("doc_id").orderBy("turn", "section_no")
    return rows.withColumn("turn", turn).withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= budget).select(chunks.columns)


def merged(own: Column, more: Column, most: int) -> Column:
    """Trimmed, non-empty, distinct values of both in order, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(own, more), X.trim), lambda x: x != "")), 1, most)


def asked(todo: DataFrame, enricher: Enricher, parallel: int | None = None) -> DataFrame:
    """todo: chunk_id, title, text -> chunk_id, summary, entities, relations, failure.

    ``parallel`` is how many chunks are asked for at a time: as many tasks, which ask one after the other. An enricher
    that raises fails for its chunk only, with the error as ``failure``.
    """
    todo = todo.repartition(parallel) if parallel else todo

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t, x in zip(f["chunk_id"], f["title"], f["text"], strict=True):
                found, failure = None, None
                try:
                    found = enricher(t, x)
                except Exception as e:  # whatever a backend may raise
                    failure = f"{type(e).__name__}: {e}"
                rows.append((k, *(found if isinstance(found, tuple) else (None, None, None)), found if isinstance(found, str) else None, failure))
            yield pd.DataFrame(rows, columns=["chunk_id", "told", "named", "related", "reply", "failure"])

    got = todo.mapInPandas(run, "chunk_id string, told string, named array<string>, related array<string>, reply string, failure string").withColumn("parsed", parse_reply("reply"))
    return got.select("chunk_id", F.coalesce("told", "parsed.summary").alias("summary"), F.coalesce("named", "parsed.entities").alias("entities"), F.coalesce("related", "parsed.relations").alias("relations"), "failure")


def enrich(chunks: DataFrame, enricher: Enricher, budget: int = 400, parallel: int | None = None) -> DataFrame:
    """chunks with summary, entities and links of those without a summary extended by the scorer.

    A result without a summary still adds its entities and links; its chunk stays one without a summary.
    """
    missing = chunks.filter(F.coalesce("summary", F.lit("")) == "")
    todo = select_targets(missing, budget).select("chunk_id", "title", X.cut(F.col("text"), SEEN).alias("text"))
    got = asked(todo, enricher, parallel).select("chunk_id", F.col("summary").alias("new_summary"), F.col("entities").alias("new_entities"), "relations")
    none = F.array().cast("array<string>")
    more = lambda own, new, most: F.when(F.size(new) > 0, merged(F.coalesce(own, none), F.col(new), most)).when(F.col("new_summary") != "", merged(F.coalesce(own, none), none, most)).otherwise(F.col(own))
    rows = chunks.join(got, "chunk_id", "left")
    return rows.withColumns(
        {
            "entities": more("entities", "new_entities", S.CHUNK_ENTITIES),
            "links": more("links", "relations", S.CHUNK_LINKS),
            "summary": F.when(F.col("new_summary") != "", F.col("new_summary")).otherwise(F.col("summary")),
        }
    ).select(chunks.columns)


def document_summary(chunks: DataFrame) -> DataFrame:
    """doc_id, summary: its first five chunk summaries joined by spaces."""
    has = chunks.filter(F.coalesce("summary", F.lit("")) != "")
    parts = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "summary"))), lambda x: x["summary"]), 1, 5)
    return has.groupBy("doc_id").agg(F.array_join(parts, " ").alias("summary"))


def coverage(chunks: DataFrame) -> DataFrame:
    """doc_id, chunks, enhanced, sections, covered (sections with a summary), progress (98 at most until all are done)."""
    has = (F.coalesce("summary", F.lit("")) != "").cast("int")
    per = group_sections(chunks).groupBy("doc_id", "section_no").agg(F.count("*").alias("n"), F.sum(has).alias("e"))
    rows = per.groupBy("doc_id").agg(F.sum("n").alias("chunks"), F.sum("e").alias("enhanced"), F.count("*").alias("sections"), F.count_if(F.col("e") > 0).alias("covered"))
    return rows.withColumn("progress", F.least(F.lit(98), F.round(100 * F.col("enhanced") / F.col("chunks")).cast("int")))
