"""Documents whose first lines have no words, and searches that scan chunks in place."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import text as X
from tessera.operators import index, search
from tests.test_engine import chunk_rows

LINES = ["####", "......... 12", "a", "7", "--- ---", "x 1", "Plain Words here"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """An input folder of documents that begin oddly."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, f"{line}\nThe text of Number {k} about Zeta Beta", "en", "src1") for k, line in enumerate(LINES * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.withColumn("n_chars", F.length("text").cast("long")).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["document_frequency", "field_weighted_tokens", "index_after_replace", "pdf_salvage", "term_frequency", "corpus_stats", "local_chunks"])
def test_first_lines_without_words(spark, odd, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    result = db.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    got = __spark_entry__.queries()[name](spark, odd).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(result.fetchall(), key=repr)


def test_entities_and_counts_in_batches(spark):
    row = spark.createDataFrame([("源 NAT", None, "802.1Q v1.2- 源地址", ["Ab cd"])], "title string, summary string, text string, entities array<string>")
    got = row.select(X.term_counts("title", "summary", "text", "entities").alias("n"), X.chunk_tokens("title", "summary", "text", "entities").alias("ts")).first()
    assert got.n.length == len(got.ts) and {t.term: t.tf for t in got.n.terms} == {t: got.ts.count(t) for t in got.ts}


def test_scan_keeps_ties_and_vetoes(spark):
    """Copies tie by place and id, far more of them than the best; chunks that share one letter only are no hits."""
    rows = [(f"d{k:03}", k % 2, "t", "same words here") for k in range(300)] + [("z", 0, "t", "i a"), ("y", 0, "t", "words i")]
    made = index.build_index(chunk_rows(spark, rows).repartition(7))
    terms = search.query_terms(spark.createDataFrame([("q", "same words i"), ("r", "i a"), ("none", "absent")], "query_id string, text string"))
    for options in ({}, {"strict": False}, {"top_k": 12, "least": 0.5}):
        shown = [sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9), tuple(r.terms)) for r in search.best(made, terms, at_once=n, **options).collect()) for n in (0, 10**9)]
        assert shown[0] == shown[1] and shown[0]
