"""One knowledge base over a table store: lists, search, reading, answers, graph, exports, folders and tags."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.operators import enrich, export, folders, graph, listing, reading, search, store
from tessera.operators.index import Segments
from tessera.sources import extract, sinks
from tessera.storage import checkpointed
from tessera.streaming import ingest, runs


def bounded_int(value: object, default: int, low: int, high: int) -> int:
    """A whole number within bounds; anything that is no number gives the default."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value in (float("inf"), float("-inf")):
        return default
    return max(low, min(high, int(value // 1)))


def string_list(value: object) -> list[str]:
    """The trimmed strings of a list that are not blank; of anything else, none."""
    return [x.strip() for x in value if isinstance(x, str) and x.strip()] if isinstance(value, list | tuple) else []


def flag(value: object, default: bool = False) -> bool:
    """A truth value; anything else gives the default."""
    return value if isinstance(value, bool) else default


class KnowledgeBase:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, store.Tables(spark, path)

    @property
    def docs(self) -> DataFrame:
        return self.tables.read("docs", S.DOCS)

    @property
    def chunks(self) -> DataFrame:
        return self.tables.read("chunks", S.CHUNKS)

    @property
    def folders(self) -> DataFrame:
        return self.tables.read("folders", S.FOLDERS)

    def index(self) -> Segments:
        return self.tables.segments()

    def _one(self, doc_id: str) -> DataFrame:
        return self.spark.createDataFrame([(doc_id,)], "doc_id string")

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text or "")], "query_id long, text string")

    def list_documents(self, name: str | None = None, tag: str | None = None, limit: object = 20) -> DataFrame:
        counted = listing.with_counts(self.docs, self.chunks)
        return listing.document_rows(listing.list_documents(counted, name, tag, bounded_int(limit, 20, 1, 100)))

    def search(self, query: str, top_k: object = S.TOP_K, doc_id: str | None = None, tags: Sequence[str] = (), least: float = 0.0) -> DataFrame:
        tags = string_list(tags)
        unknown = self.unknown_tags(tags) if tags else []
        known = [t for t in tags if t not in unknown]
        if tags and not known:
            return search.search(self.index(), self.chunks, self.docs.limit(0), self._query(query))
        return search.search(self.index(), self.chunks, self.docs, self._query(query), bounded_int(top_k, S.TOP_K, 1, S.MOST_TOP_K), doc_id, known, least)

    def search_text(self, query: str, **options) -> str:
        """The reply of a search as text: hits, documents that the query names, or why there are none."""
        if not (query or "").strip():
            return "查询不能为空。"
        if not self.chunks.limit(1).count():
            return "知识库中还没有已解析的文档。"
        missing = self.unknown_tags(options.get("tags", ()))
        if missing and len(missing) == len(options.get("tags", ())):
            catalogue = [r["tag"] for r in listing.tag_counts(self.docs).limit(20).collect()]
            return f"没有文档带有标签：{'、'.join(missing)}。现有标签：{'、'.join(catalogue)}"
        hits = self.search(query, **options)
        text = search.render_hits(hits).first()
        named = search.named_documents(self._query(query), self.docs, hits).orderBy("name").collect()
        head = f"知识库检索「{query}」，命中 {text['hits']} 段：\n\n{text['markdown']}" if text else f"知识库中没有找到与「{query}」相关的内容。"
        lines = "\n".join(f"- {r['name']}（docId: {r['doc_id']}）" for r in named)
        return f"{head}\n查询「{query}」还匹配到以下文档：\n{lines}" if named else head

    def unknown_tags(self, tags: Sequence[str]) -> list[str]:
        wanted = self.spark.createDataFrame([(t,) for t in tags], "tag string")
        return sorted(r["tag"] for r in listing.unknown_tags(self.docs, wanted).collect())

    def read_document(self, doc_id: str, page: object = 1, page_size: object = 8) -> DataFrame:
        return reading.read_pages(self.tables.read("chunks", S.CHUNKS, [doc_id]), bounded_int(page, 1, 1, 1 << 30), bounded_int(page_size, 8, 1, 40), doc_id)

    def ask(self, query: str, answer: Callable[[str, str], str], top_k: object = 12, **options) -> dict | None:
        """An answer with its references; None if there are too few passages or the composer says nothing."""
        hits = self.search(query, bounded_int(top_k, 12, S.LEAST_PASSAGES, S.MOST_TOP_K), **options)
        row = search.passages(hits).first()
        if row is None or row["n"] < S.LEAST_PASSAGES:
            return None
        text = (answer(query, row["passages"]) or "").strip()
        if not text:
            return None
        cited = self.spark.range(1).select(search.cited_passages(F.lit(text), F.lit(row["n"]))).first()[0]
        refs = hits.filter(F.col("rank") <= (max(cited) if cited else row["n"])).orderBy("rank").select("rank", "doc_id", "doc_name", search.section_of().alias("section"), "page").collect()
        return {"answer": text, "cited": cited, "references": [r.asDict() for r in refs]}

    def ask_text(self, query: str, answer: Callable[[str, str], str], model: str | None = None, **options) -> str | None:
        """``ask`` as text: the answer, its references and a note."""
        found = self.ask(query, answer, **options)
        if found is None:
            return None
        hits = self.search(query, bounded_int(options.pop("top_k", 12), 12, S.LEAST_PASSAGES, S.MOST_TOP_K), **options)
        said = self.spark.createDataFrame([(0, found["answer"], model)], "query_id long, answer string, model string")
        return search.render_answers(said, hits).first()["text"]

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.capped(graph.graph_nodes(self.docs, self.chunks), graph.graph_edges(self.chunks))

    def status(self) -> DataFrame:
        return listing.with_graph_size(listing.status_totals(listing.with_counts(self.docs, self.chunks)), *self.graph())

    def tags(self) -> DataFrame:
        return listing.tag_counts(self.docs)

    def set_tags(self, doc_id: str, tags: list[str]) -> None:
        self.tables.change("docs", S.DOCS, lambda docs: store.set_tags(docs, doc_id, tags), self._one(doc_id))

    def delete_document(self, doc_id: str) -> None:
        gone = self._one(doc_id)
        self.tables.put_chunks(self.spark.createDataFrame([], S.CHUNKS), gone)
        self.tables.change("docs", S.DOCS, lambda docs: docs.limit(0), gone)

    def add_files(self, path: str, enricher: enrich.Enricher | None = None) -> DataFrame:
        """Takes the files under a path; those that are refused, with the reason."""
        good, bad = extract.uploads(extract.read_files(self.spark, path))
        ingest.take(good, self.tables, enricher)
        return bad

    def add_file(self, doc_id: str, name: str, content: bytes, enricher: enrich.Enricher | None = None) -> str | None:
        """Takes one file, in place of what has its id; the reason, if it is refused."""
        schema = "doc_id string, name string, declared string, content binary, size long, uploaded_at timestamp"
        row = self.spark.createDataFrame([(doc_id, name, None, content, len(content), datetime.datetime.now())], schema)
        good, bad = extract.uploads(row)
        ingest.take(good, self.tables, enricher)
        refused = bad.first()
        return refused["reason"] if refused else None

    def enrich_all(self, enricher: enrich.Enricher | None = None, budget: int = 400) -> int:
        """Enriches what is left in batches; the number of batches."""
        return runs.run(self.tables, enricher or enrich.FirstSentence(), budget)

    def cancel(self, doc_id: str) -> None:
        runs.cancel(self.tables, self._one(doc_id))

    def resume(self) -> DataFrame:
        """Queues again what was cut off: doc_id, phase."""
        return runs.resume(self.tables)

    def folder_list(self) -> DataFrame:
        """The folders in display order with their paths and numbers of documents."""
        counts = folders.doc_counts(self.folders, self.docs)
        return folders.display_order(self.folders).join(folders.paths(self.folders).select("folder_id", "path"), "folder_id").join(counts, "folder_id").orderBy("place")

    def enrich(self, enricher: enrich.Enricher | None = None, budget: int = 400) -> None:
        self.tables.write("chunks", enrich.enrich(self.chunks, enricher or enrich.FirstSentence(), budget))

    def exports(self, doc_id: str | None = None) -> DataFrame:
        """doc_id, markdown, mindmap."""
        docs = self.docs if doc_id is None else self.docs.filter(F.col("doc_id") == doc_id)
        chunks = self.chunks.join(docs.select("doc_id"), "doc_id", "left_semi")
        return export.markdown(docs, chunks).join(export.mind_map(docs, chunks), "doc_id")

    def export_files(self, path: str, doc_id: str | None = None) -> DataFrame:
        """Writes both exports of all documents, or of one, below a path; their names (file), which do not clash."""
        named = self.exports(doc_id).join(sinks.export_names(self.docs), "doc_id")
        both = F.array(*[F.struct(F.col(f"{kind}_file").alias("file"), F.col(column).alias("content")) for kind, column in (("md", "markdown"), ("mindmap", "mindmap"))])
        files = checkpointed(named.select(F.explode(both).alias("x")).select("x.*"))
        sinks.write_exports(files, path)
        return files.select("file")

    def create_folder(self, folder_id: str, name: str, parent_id: str | None = None) -> None:
        self.tables.write("folders", folders.create(self.folders, folder_id, name, parent_id))

    def rename_folder(self, folder_id: str, name: str) -> None:
        self.tables.write("folders", folders.rename(self.folders, folder_id, name))

    def move_folder(self, folder_id: str, parent_id: str | None) -> None:
        self.tables.write("folders", folders.move(self.folders, folder_id, parent_id))

    def delete_folder(self, folder_id: str) -> None:
        left, docs = folders.delete(self.folders, self.docs, folder_id)
        left = checkpointed(left)
        self.tables.write("docs", docs)
        self.tables.write("folders", left)

    def file_document(self, doc_id: str, folder_id: str | None) -> None:
        self.tables.change("docs", S.DOCS, lambda docs: store.set_folder(docs, self.folders, doc_id, folder_id), self._one(doc_id))
