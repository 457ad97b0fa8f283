"""Which of many strings a text contains: an automaton inside a document, trigram joins between tables."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def occurring(texts: list[str | None], patterns: list[str | None]) -> list[set[int]]:
    """Of each text: the places of the patterns that occur in it.

    One automaton finds all of them in one pass over each text, so time grows with the texts' length and what is found,
    not with texts times patterns. Empty patterns occur everywhere; nulls nowhere.
    """
    machine, empty = ahocorasick.Automaton(), []
    for k, p in enumerate(patterns):
        if p:
            machine.add_word(p, machine.get(p, ()) + (k,))
        elif p is not None:
            empty.append(k)
    if len(machine):
        machine.make_automaton()
    found = []
    for t in texts:
        hits = set(empty) if t is not None else set()
        if len(machine) and t:
            hits.update(k for ks in {ks for _, ks in machine.iter(t)} for k in ks)
        found.append(hits)
    return found


@arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def contained(texts: pa.Array, patterns: pa.Array, names: pa.Array) -> pa.Array:
    """Of each document's texts: the names of those of its patterns, in their order, that occur in the text."""
    rows = zip(texts.to_pylist(), patterns.to_pylist(), names.to_pylist(), strict=True)
    return pa.array([None if ts is None else [[ns[k] for k in sorted(ks)] for ks in occurring(ts, ps or [])] for ts, ps, ns in rows], pa.list_(pa.list_(pa.string())))


#: Characters at a pattern's start that it is looked up by.
HEAD = 32


@arrow_udf(T.ArrayType(T.IntegerType()))
def longest_contained(texts: pa.Array, patterns: pa.Array) -> pa.Array:
    """Of each document's texts: the place (from 0) of the longest of its patterns that the text contains, the first of
    several; null if there is none. Patterns have HEAD characters at least; shorter ones and nulls are passed over.

    An automaton finds the first characters of all patterns in one pass over each text, so time grows with the texts' length.
    """
    out = []
    for ts, ps in zip(texts.to_pylist(), patterns.to_pylist(), strict=True):
        heads: dict[str, list[int]] = {}
        for k in sorted((k for k, p in enumerate(ps or []) if p and len(p) >= HEAD), key=lambda k: (-len(ps[k]), k)):
            heads.setdefault(ps[k][:HEAD], []).append(k)
        machine = ahocorasick.Automaton()
        for head, ks in heads.items():
            machine.add_word(head, ks)
        if heads:
            machine.make_automaton()
        found = []
        for t in ts or []:
            best = None
            for end, ks in machine.iter(t) if heads and t else ():
                i = end - HEAD + 1
                for k in ks:  # longest first
                    if best is not None and (len(ps[k]), -k) <= (len(ps[best]), -best):
                        break
                    if t.startswith(ps[k], i):
                        best = k
                        break
            found.append(best)
        out.append(None if ts is None else found)
    return pa.array(out, pa.list_(pa.int32()))


def grams(text: str | Column, size: int) -> Column:
    """The distinct substrings of so many characters."""
    t = F.col(text) if isinstance(text, str) else text
    every = F.transform(F.sequence(F.lit(1), F.length(t) - (size - 1)), lambda k: F.substring(t, k, F.lit(size)))
    return F.when(F.length(t) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _rarest(rows: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """text, key: of each distinct text of three characters or more the gram that the fewest names have, of shorter ones all of it."""
    words = rows.select(text).distinct()
    long = words.filter(F.length(text) > 2).select(text, F.explode(grams(text, 3)).alias("gram")).join(counts, "gram", "left")
    found = long.groupBy(text).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("key"))
    return found.unionByName(words.filter(F.length(text) <= 2).select(text, F.col(text).alias("key")))


def _keyed(rows: DataFrame, text: str) -> DataFrame:
    """text, key: all that a text of up to two or three characters within it may be found by."""
    words = rows.select(text).distinct()
    every = reduce(lambda a, b: F.concat(a, b), (grams(text, size) for size in (1, 2, 3)))
    return words.select(text, F.explode(F.concat(F.array(F.lit("")), every)).alias("key"))


def containing(names: DataFrame, queries: DataFrame) -> DataFrame:
    """names: n; queries: q -> distinct n, q where one contains the other.

    A text is looked up by its rarest trigram among the trigrams of those that may contain it, so both ways are
    equi-joins; what they find is confirmed. Empty texts are contained in all.
    """
    names, queries = names.select("n").filter("n is not null").distinct(), queries.select("q").filter("q is not null").distinct()
    counts = names.select(F.explode(grams("n", 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_names")).withColumnRenamed("n_names", "n")
    inner = _rarest(queries, "q", counts).join(_keyed(names, "n"), "key").filter(F.contains("n", "q"))
    outer = _rarest(names.withColumnRenamed("n", "t"), "t", counts).withColumnRenamed("t", "name").join(_keyed(queries, "q"), "key").filter(F.contains("q", "name"))
    return inner.select("n", "q").unionByName(outer.select(F.col("name").alias("n"), "q")).distinct()
