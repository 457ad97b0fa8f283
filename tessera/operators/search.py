"""Ranked search over the index, for one query or a table of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import containment
from tessera.operators.index import Index, Segments, bucket_of
from tessera.storage import checkpointed, local_table

#: Query terms that may be broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 50_000


def few_rows(rows: DataFrame) -> DataFrame:
    """``rows``, marked to be broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else rows


def query_terms(queries: DataFrame) -> DataFrame:
    """queries: query_id, text -> query_id, place, term: each distinct term once, in order of appearance."""
    return queries.select("query_id", F.posexplode(F.array_distinct(X.tokenize("text"))).alias("place", "term")).filter("term != ''")


def _gain(tf: Column, length: Column, n: int, mean: float) -> Column:
    """What a term adds to a chunk's score; larger for larger tf and smaller length."""
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - S.B + S.B * (length / mean if mean > 0 else F.lit(1.0))
    return idf * (tf * (S.K1 + 1)) / (tf + S.K1 * norm)


@dataclass
class Asked:
    """Query terms that the index has, with their frequencies; the index as far as they need it; its statistics.

    few: the terms are few enough to be held by the driver; queries, rows, held: then, the number of queries that they
    belong to, and of pairs of a query's term and a posting, and the terms (query_id, place, term, df).
    """

    terms: DataFrame
    index: Index
    n: int
    mean: float
    docs: DataFrame | None = None
    few: bool = True
    queries: int = 0
    rows: int | None = None
    held: list[tuple] = field(default_factory=list)

    @staticmethod
    def of(index: Index | Segments, terms: DataFrame, stats: tuple[int, float] | None = None, docs: DataFrame | None = None) -> Asked:
        spark, docs = terms.sparkSession, None if docs is None else docs.select("doc_id").distinct()
        rows = terms.select("query_id", "place", "term", bucket_of("term", getattr(index, "buckets", 1))).limit(BROADCAST_TERMS + 1).collect()
        n, mean = stats or index.stats()
        if len(rows) > BROADCAST_TERMS:
            all_ = index.index() if isinstance(index, Segments) else index
            return Asked(checkpointed(terms.join(all_.frequencies, "term")), all_, n, mean, docs, False)
        words = sorted({r[2] for r in rows})
        near = index.narrowed(words, sorted({r[3] for r in rows}))
        term = T.StructType([T.StructField("term", T.StringType())])
        found = near.frequencies.join(F.broadcast(local_table(spark, [(w,) for w in words], term)), "term", "left_semi").collect()
        df = {r["term"]: r["df"] for r in found}
        schema = T.StructType([*terms.select("query_id", "place", "term").schema.fields, T.StructField("df", T.LongType())])
        held = [(*r[:3], df[r[2]]) for r in rows if r[2] in df]
        return Asked(F.broadcast(local_table(spark, held, schema)), near, n, mean, docs, True, len({r[0] for r in rows}), sum(df.get(r[2], 0) for r in rows), held)

    def scored(self) -> DataFrame:
        """query_id, doc_id, chunk_id, chunk_index, score, longest of all chunks."""
        postings = self.index.postings if self.docs is None else self.index.postings.join(self.docs, "doc_id", "left_semi")
        if self.few and self.queries > 1:
            # a chunk's postings meet before queries multiply them, so sums need no shuffle of their own
            postings = postings.repartition("chunk_id")
        rows = postings.join(self.terms, "term")
        gain = _gain(F.col("tf"), F.col("length"), self.n, self.mean)
        return rows.groupBy("query_id", "doc_id", "chunk_id", "chunk_index").agg(F.sum(gain).alias("score"), F.max(F.length("term")).alias("longest"))

    def scanned(self, k: int, least: float, strict: bool) -> DataFrame:
        """query_id, doc_id, chunk_id, chunk_index, score, terms (the first eight) of all that may be among a query's k best."""
        spark, rows = self.terms.sparkSession, self.index.counted
        if self.docs is not None:
            rows = rows.join(few_rows(self.docs), "doc_id", "left_semi")
        ids = sorted({r[0] for r in self.held})
        number = {x: q for q, x in enumerate(ids)}
        held = [(number[a], b, c, d) for a, b, c, d in self.held]
        found = rows.select("chunk_id", "doc_id", "chunk_index", "length", "terms").mapInArrow(_scanner(held, self.n, self.mean, k, least, strict), SCANNED)
        schema = T.StructType([T.StructField("q", T.IntegerType()), self.terms.schema["query_id"]])
        return found.join(F.broadcast(local_table(spark, list(enumerate(ids)), schema)), "q").drop("q")

    def with_terms(self, top: DataFrame) -> DataFrame:
        """Ranked chunks with the first eight of the query's terms that they match, in the query's order."""
        ids = top.select("query_id", "chunk_id")
        few = self.few and self.queries * S.MOST_TOP_K <= BROADCAST_TERMS
        hint = F.broadcast if few else (lambda df: df)
        mine = self.index.postings.select("term", "chunk_id").join(hint(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")
        rows = mine.join(self.terms, "term").join(hint(ids), ["query_id", "chunk_id"], "left_semi")
        listed = rows.groupBy("query_id", "chunk_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), 1, 8).alias("terms"))
        return top.join(hint(listed), ["query_id", "chunk_id"])


def scores(index: Index | Segments, terms: DataFrame, stats: tuple[int, float] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """BM25 sums of all chunks: query_id, doc_id, chunk_id, chunk_index, score, longest (the length of its longest term).

    Frequencies and lengths are those of the whole corpus; ``docs`` (doc_id) restricts only what is scored.
    """
    return Asked.of(index, terms, stats, docs).scored()


def _order() -> WindowSpec:
    return Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_index", "chunk_id")


def _hits(found: DataFrame, least: float, strict: bool) -> DataFrame:
    good = found.filter(F.col("score") > least)
    return good.filter("longest >= 2") if strict else good


def ranked(found: DataFrame, top_k: int = S.TOP_K, least: float = 0.0, strict: bool = True) -> DataFrame:
    """The best chunks of each query with rank and score relative to the best.

    A hit needs a term of two letters or more, unless ``strict`` is off. Scores that agree to nine places tie
    (the order of a sum's terms is not fixed); ties go to the earlier chunk, then id.
    """
    k = max(1, min(top_k, S.MOST_TOP_K))
    top = _hits(found, least, strict).withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top.withColumn("relative", F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)))


#: Pairs of a query's term and a posting up to which postings are read by term; scores that a task holds at a time.
AT_ONCE, HELD_SCORES = 5_000_000, 4_000_000


def best(index: Index | Segments, terms: DataFrame, top_k: int = S.TOP_K, least: float = 0.0, strict: bool = True, docs: DataFrame | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """``ranked`` of the chunks' ``scores``, with the terms they match.

    Up to ``at_once`` pairs of a term and a posting are read by term and joined. A larger search scans the chunks' terms
    in place: each task scores all its chunks for all queries and keeps the best of each, so that nothing but these is
    shuffled. The result is the same.
    """
    asked = Asked.of(index, terms, None, docs)
    k = max(1, min(top_k, S.MOST_TOP_K))
    if asked.index.counted is None or not asked.few or asked.rows <= at_once:
        return asked.with_terms(checkpointed(ranked(asked.scored(), k, least, strict)))
    return checkpointed(ranked(asked.scanned(k, least, strict), k, least, False))


def _scanner(held: list[tuple], n: int, mean: float, k: int, least: float, strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """held: q, place, term, df. Batches of chunk_id, doc_id, chunk_index, length, terms -> SCANNED: of each task's chunks
    all that may be among a query's k best, by adding up what each term gives, term by term."""
    words = sorted({(len(t) < 2, t, df) for _, _, t, df in held})  # those of one letter last
    number = {t: i for i, (_, t, _) in enumerate(words)}
    queries = max(q for q, *_ in held) + 1
    asking: list[list[int]] = [[] for _ in words]
    listed: list[list[tuple[int, str]]] = [[] for _ in range(queries)]
    for q, _, t, _ in sorted(held, key=lambda x: (x[0], x[1])):
        asking[number[t]].append(q)
        listed[q].append((number[t], t))
    idf = np.array([math.log(1 + (n - df + 0.5) / (df + 0.5)) for _, _, df in words])
    first_short = sum(not short for short, *_ in words)

    def hits(batch: pa.RecordBatch, bar: np.ndarray) -> pa.RecordBatch:
        rows, lists = batch.num_rows, batch.column("terms")
        flat = lists.flatten()
        ids = pc.fill_null(pc.index_in(flat.field("term"), value_set=pa.array([t for _, t, _ in words], pa.string())), -1).to_numpy()
        row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        known = ids >= 0
        ids, row, tf = ids[known], row[known], flat.field("tf").to_numpy()[known].astype(float)
        length = batch.column("length").to_numpy()[row]
        gain = idf[ids] * (tf * (S.K1 + 1)) / (tf + S.K1 * (1 - S.B + S.B * (length / mean if mean > 0 else 1.0)))
        order = np.argsort(ids, kind="stable")
        at = np.searchsorted(ids[order], np.arange(len(words) + 1))
        scores, good = np.zeros((queries, rows)), None
        for w in range(len(words)):
            if strict and w == first_short:
                good = scores > 0
            mine = order[at[w] : at[w + 1]]
            if len(mine):
                scores[np.ix_(asking[w], row[mine])] += gain[mine]
        good = scores > least if good is None else good & (scores > least)
        scores[~good] = -np.inf
        if rows >= k:
            np.maximum(bar, np.partition(scores, rows - k, axis=1)[:, rows - k], out=bar)
        q, c = np.nonzero(good & (scores >= bar[:, None] - 2e-9))  # scores that agree to nine places tie
        s, place = scores[q, c], batch.column("chunk_index").to_numpy()[c]
        name = np.array(batch.column("chunk_id").take(pa.array(c)).to_pylist(), dtype=object)
        by = np.lexsort((np.unique(name, return_inverse=True)[1] if len(c) else c, place, -s, q))
        q, c, s = q[by], c[by], s[by]
        fresh = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (s[1:] != s[:-1]))) if len(q) else np.zeros(0, bool))
        kept = np.arange(len(q)) - np.repeat(fresh, np.diff(np.append(fresh, len(q)))) < k  # of equal scores k are enough
        q, c, s = q[kept], c[kept], s[kept]
        ends = np.searchsorted(row, np.arange(rows + 1))
        found = []
        for a, b in zip(q.tolist(), c.tolist(), strict=True):
            has = set(ids[ends[b] : ends[b + 1]].tolist())
            found.append([t for i, t in listed[a] if i in has][:8])
        taken = batch.select(["doc_id", "chunk_id", "chunk_index"]).take(pa.array(c))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), *taken.columns, pa.array(s), pa.array(found, pa.list_(pa.string()))], ["q", "doc_id", "chunk_id", "chunk_index", "score", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar, most = np.full(queries, -np.inf), max(1, HELD_SCORES // queries)
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                yield hits(batch.slice(i, most), bar)

    return run


SCANNED = "q int, doc_id string, chunk_id string, chunk_index int, score double, terms array<string>"


def tag_scope(docs: DataFrame, tags: Sequence[str]) -> DataFrame:
    """The documents that carry one of the tags at least."""
    wanted = [t for t in (x.strip().lower() for x in tags) if t]
    return docs.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(True)).select("doc_id")


def search(index: Index | Segments, chunks: DataFrame, docs: DataFrame, queries: DataFrame, top_k: int = S.TOP_K, doc_id: str | None = None, tags: Sequence[str] = (), least: float = 0.0, strict: bool = True, centre: bool = False) -> DataFrame:
    """queries: query_id, text -> query_id, rank, doc_id, doc_name, doc_tags, chunk columns, score, terms, snippet."""
    scope = tag_scope(docs, tags) if tags else None
    if doc_id is not None:
        scope = (scope if scope is not None else docs.select("doc_id")).filter(F.col("doc_id") == doc_id)
    top = best(index, query_terms(queries), top_k, least, strict, scope)
    top = few_rows(checkpointed(top))  # neither chunks nor documents are shuffled for some hits
    named = docs.join(top, "doc_id", "left_semi").select("doc_id", F.col("name").alias("doc_name"), F.col("tags").alias("doc_tags"))
    hits = chunks.join(top.drop("chunk_index"), ["doc_id", "chunk_id"]).join(named, "doc_id")
    snippet = X.snippet("text", F.col("terms") if centre else None)
    return hits.select("query_id", "rank", "doc_id", "doc_name", "doc_tags", "chunk_id", "chunk_index", "title", "text", "summary", "entities", "page", "section_path", F.col("relative").alias("score"), "terms", snippet.alias("snippet"))


# Words of a question, which names no document.
QUESTION = "[？?]|怎么|如何|什么|哪些|是否|为什么|为何|请问|解释|介绍"


def named_documents(queries: DataFrame, docs: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and doc_id of documents that a title-like query names and that are no hits of it yet."""
    t = X.trim(F.col("text"))
    title_like = (F.length(t) >= 2) & (F.length(t) <= 60) & ~t.rlike(QUESTION) & ~(t.rlike(f"[{X.WS}]") & t.rlike(f"[{X.IDEOGRAPHS}]"))
    asked = queries.filter(title_like).select("query_id", F.lower(t).alias("q"))
    names = docs.select("doc_id", "name", F.lower("name").alias("n"))
    pairs = names.join(containment.containing(names, asked), "n").join(asked, "q")
    return pairs.join(hits.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "name")


def section_of() -> F.Column:
    """A chunk's section path, else its title."""
    return F.when(F.size("section_path") > 0, F.array_join("section_path", " / ")).otherwise(F.col("title"))


def render_hits(hits: DataFrame) -> DataFrame:
    """query_id and one Markdown string of its hits in order."""
    page = F.when(F.col("page") > 0, F.concat(F.lit("p."), F.col("page").cast("string")))
    where = F.concat_ws(" · ", page, F.when(section_of() != "", section_of()))
    head = F.concat(F.col("rank").cast("string"), F.lit(". **"), F.col("title"), F.lit("**（"), F.col("doc_name"), F.when(where != "", F.concat(F.lit(" · "), where)).otherwise(F.lit("")), F.lit("）"))
    tags = F.when(F.size("doc_tags") > 0, F.concat(F.lit("   - 标签："), F.array_join("doc_tags", "、")))
    gist = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("   - 摘要："), F.col("summary")))
    named = F.when(F.size("entities") > 0, F.concat(F.lit("   - 实体："), F.array_join(F.slice("entities", 1, 6), "、")))
    quote = F.array_join(F.transform(F.slice(F.split(X.trim("snippet"), "\n", -1), 1, 6), lambda x: F.concat(F.lit("   > "), x)), "\n")
    block = F.concat_ws("\n", head, tags, gist, named, F.when(X.trim("snippet") != "", quote), F.lit(""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n")
    return hits.groupBy("query_id").agg(joined.alias("markdown"), F.count("*").alias("hits"))


def result_rows(hits: DataFrame) -> DataFrame:
    """Hits as a search gives them to programs: scores of three digits, six entities at most."""
    return hits.withColumn("score", F.round("score", 3)).withColumn("entities", F.slice("entities", 1, 6))


# The labels of a written answer.
REFERENCES, BY_MODEL, TO_CHECK = "引用：\n", "回答模型：", "_注意：这是另一个模型基于检索片段的结论。若要复核，请用 kb_search 读回被引用的片段。_"


def render_answers(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """answers: query_id, answer, model (may be null) -> query_id, text: the answer with its references and a note.

    References are the passages up to the highest one that the answer cites, all if it cites none.
    """
    where = F.concat_ws(" · ", "doc_name", F.when(section_of() != "", section_of()), F.when(F.col("page") > 0, F.concat(F.lit("p."), F.col("page").cast("string"))), F.concat(F.lit("docId: "), "doc_id"))
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), where).alias("line"))))
    listed = hits.groupBy("query_id").agg(lines.alias("lines"))
    rows = answers.join(listed, "query_id", "left").withColumn("cited", cited_passages(F.col("answer"), F.coalesce(F.size("lines"), F.lit(0))))
    kept = F.when(F.size("cited") > 0, F.filter("lines", lambda x: x["rank"] <= F.array_max("cited"))).otherwise(F.col("lines"))
    cited = F.when(F.size(kept) > 0, F.concat(F.lit(REFERENCES), F.array_join(F.transform(kept, lambda x: x["line"]), "\n")))
    by = F.when(F.coalesce("model", F.lit("")) != "", F.concat(F.lit(BY_MODEL), "model"))
    return rows.select("query_id", F.concat_ws("\n\n", "answer", cited, by, F.lit(TO_CHECK)).alias("text"))


def passages(hits: DataFrame) -> DataFrame:
    """query_id and the numbered passages that an answer is written from."""
    body = F.when(F.length("text") > S.PASSAGE_CHARS, F.concat(X.trim(X.cut(F.col("text"), S.PASSAGE_CHARS)), F.lit("…"))).otherwise(X.trim("text"))
    tags = F.when(F.size("doc_tags") > 0, F.concat(F.lit("（标签："), F.array_join("doc_tags", "、"), F.lit("）"))).otherwise(F.lit(""))
    page = F.when(F.col("page") > 0, F.concat(F.lit("（第 "), F.col("page").cast("string"), F.lit(" 页）"))).otherwise(F.lit(""))
    gist = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("小结："), F.col("summary"), F.lit("\n"))).otherwise(F.lit(""))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 文档："), F.col("doc_name"), tags, F.lit("\n章节："), section_of(), page, F.lit("\n"), gist, F.lit("正文："), body)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n---\n\n")
    return hits.groupBy("query_id").agg(joined.alias("passages"), F.count("*").alias("n"))


def cited_passages(answer: F.Column, total: F.Column) -> F.Column:
    """The distinct numbers from 1 to total in [n] marks, ascending."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= total))))
