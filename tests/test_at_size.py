"""Steps that large inputs pass once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking, graph, index
from tessera.operators.index import Segments
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_made_in_one_pass_with_titles_as_in_the_columns(spark):
    lines = ["1. Start here", "# A #\nb", "12) Foo，", "第 3 节 abc", "a ..... 12", "a ....12\t", "x " * 60, "", "  \n# b", "7  中文\rc", "1.2　 b ．", "##  ", "#\ta", "a" * 91 + " 1", "9 " + "y" * 61]
    d = spark.createDataFrame([(t,) for t in lines], "t string")
    got = {r.t: (r.a, r.b) for r in d.select("t", X.title_from("t").alias("a"), X.is_heading_line(X.first_line("t")).alias("b")).collect()}
    assert got == {t: (X.title_of(t), X.heads(t)) for t in lines}
    made = chunking.local_chunks(spark.createDataFrame([(1, "# Big Head\n\nabout Small Thing"), (2, None)], "doc_id long, text string"))
    assert _plan(made).count("EvalPython") == 1
    assert [(r.chunk_id, r.title, r.heading, r.entities) for r in made.collect()] == [("1#0", "Big Head", True, ["Big Head", "Small Thing"])]


def test_degrees_make_the_edges_once(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 3), ("c", "c", 1)], "source string, target string, weight long")
    found = graph.degrees(edges)
    assert "Union" not in _plan(found)
    assert {r.id: r.degree for r in found.collect()} == {"a": 2, "b": 5, "c": 5}


def test_a_segment_is_counted_while_it_is_written(spark, tmp_path):
    rows = [(f"d{i}", f"d{i}#0", 0, "t", f"w{i % 3} common", [], None) for i in range(30)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, chunk_index int, title string, text string, entities array<string>, summary string")
    made = Segments(spark, str(tmp_path / "i"))
    made.add(chunks)
    assert {r.term: r.df for r in made.index().frequencies.collect()} == {"t": 30, "common": 30, "w0": 10, "w1": 10, "w2": 10}
    assert made.index().postings.select(F.sum("tf")).first()[0] == 30 * 5 and made.stats() == (30, 5.0)
    made.add(chunks.withColumns({"title": F.lit(""), "text": F.lit("")}))  # no terms any more
    assert made.index().postings.count() == 0 and made.stats() == (30, 0.0)


def test_postings_are_stored_by_term_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FILE_ROWS", 10)
    rows = [(f"d{i}", f"d{i}#0", 0, f"ü{i % 5}", f"w{i % 3} common w{i % 3} 漢字", ["Some Name"], None) for i in range(60)]
    rows[7] = ("d7", "other", *rows[7][2:])
    rows += [("e", "e#0", 0, "", "", [], None)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, chunk_index int, title string, text string, entities array<string>, summary string").repartition(3)
    made, plain = Segments(spark, str(tmp_path / "i"), 4), index.build_index(chunks)
    made.add(chunks)
    held = lambda df: sorted(map(tuple, df.select("term", "doc_id", "chunk_id", "chunk_index", "tf", "length").collect()))
    assert held(made.index().postings) == held(plain.postings)
    assert held(made.narrowed(["common", "w1"], list(range(4))).postings) == held(plain.postings.filter("term in ('common', 'w1')"))
    monkeypatch.setattr(index, "PUSHED_TERMS", 1)
    assert held(made.narrowed(["common", "w1"], list(range(4))).postings) == held(plain.postings.filter("term in ('common', 'w1')"))
    assert {(r.term, r.df) for r in made.index().frequencies.collect()} == {(r.term, r.df) for r in plain.frequencies.collect()}
    packed = index._packed(made._read("counted", index.COUNTED))
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    assert packed.count() < plain.postings.count()
    for name, n in (("BLOCK", 40), ("ROW", 7), ("SENT", 16)):
        monkeypatch.setattr(index, name, n)
    counted = made._read("counted", index.COUNTED).select("doc_id", "chunk_id", "chunk_index", "length", "terms").toArrow()
    sent = list(index._pack(iter(counted.to_batches(max_chunksize=3))))
    assert max(n for b in sent for n in b.column("n").to_pylist()) <= 7
    got = [(t, *(p[c] for c in ("doc_id", "chunk_id", "chunk_index", "tf", "length"))) for b in sent for t, n, ps in zip(*b.to_pydict().values(), strict=True) for p in ps]
    assert sorted((t, d, c or f"{d}#{i}", i, *r) for t, d, c, i, *r in got) == held(plain.postings)
    assert {d for _, d, c, *_ in got if c} == {"d7"}


def test_carried_summaries_cut_each_text_once(spark):
    assert _plan(catalogue.QUERIES["summary_carryover"](spark, SF)).count("EvalPython") == 1
