"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

All stages take documents with null ids, languages, sources and texts, rows that repeat each other in any column, texts
of any length, and empty tables (of which they make empty ones). They go by rows, not by ids: rows that share an id, or
have none, are judged each by its own text. Columns besides doc_id, text, lang, source and n_chars pass through the
stages unchanged, whatever their names, up to the last, whose columns are fixed.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, line_dedup, minhash, mixing, quality_rules
from tessera.storage import shared_folder, spread


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and short texts go; null languages and sources are groups of their own."""
    return quality_rules.keep(spread(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines, of one word or more, that an earlier line is similar to; n_chars follows the text.

    Every document stays, one whose lines all go with an empty text. Of rows that agree in id and text one counts as the
    first, and the lines of the others go.
    """
    return line_dedup.dedupe(docs, least=1).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of the least id; texts without words, null ones too, all stay."""
    return minhash.dedupe(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most; texts without words are not taken."""
    return mixing.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their packed token ids, and the text that these decode to in place of the text (null: empty)."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    back = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    text = F.decode("decoded", "UTF-8")
    return back.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"), (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("mixing", mix), ("byte_bpe", tokens)]
#: The hashes that MinHash bands and the seeded mix go by cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
