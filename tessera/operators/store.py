"""Changes to tables of documents and chunks, as plans from the old table to the new one, and these tables in buckets."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import containment
from tessera.operators.index import LENGTHS, Segments
from tessera.storage import checkpointed, stored


def upsert(table: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """table with rows in place of those with their keys. Empty and null keys are refused by leaving them out."""
    rows = rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(table.columns))


def set_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks with all those of new's documents replaced by new."""
    return chunks.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new.select(chunks.columns))


def merge_chunks(chunks: DataFrame, patch: DataFrame) -> DataFrame:
    """chunks with those that patch names by chunk_id replaced or added; the rest stays."""
    return upsert(chunks, patch, "chunk_id")


def set_tags(docs: DataFrame, doc_id: str, tags: list[str]) -> DataFrame:
    """docs with the tags of one replaced by their normal form; none is stored as null."""
    clean = X.normalize_tags(F.array(*[F.lit(t) for t in tags]).cast("array<string>"))
    return docs.withColumn("tags", F.when(F.col("doc_id") == doc_id, F.when(F.size(clean) > 0, clean)).otherwise(F.col("tags")))


def delete_documents(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents in gone (doc_id)."""
    ids = gone.select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti")


def set_folder(docs: DataFrame, folders: DataFrame, doc_id: str, folder_id: str | None) -> DataFrame:
    if folder_id is not None and not folders.filter(F.col("folder_id") == folder_id).limit(1).count():
        raise ValueError("the folder is unknown")
    return docs.withColumn("folder_id", F.when(F.col("doc_id") == doc_id, F.lit(folder_id).cast("string")).otherwise(F.col("folder_id")))


def carry_summaries(new: DataFrame, old: DataFrame, least: int = 300) -> DataFrame:
    """new chunks with the summaries of old ones of the same document: of the same text, else of the longest contained one.

    A document's chunks are brought together and matched in time in proportion to their length; contained texts of fewer
    than ``least`` characters, 32 at least, do not count.
    """
    has = old.filter(F.coalesce("summary", F.lit("")) != "").select("doc_id", "chunk_index", F.col("text").alias("old_text"), F.col("summary").alias("old_summary"))
    exact = has.groupBy("doc_id", F.col("old_text").alias("text")).agg(F.max_by("old_summary", "chunk_index").alias("same"))
    lists = lambda df, *c: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*c))).alias("x"))
    olds = lists(has.filter(F.length("old_text") >= max(least, containment.HEAD)), F.col("chunk_index").alias("old"), "old_text", "old_summary").toDF("doc_id", "olds")
    news = lists(new, "chunk_id", "text").toDF("doc_id", "news")
    both = news.join(olds, "doc_id").withColumn("at", containment.longest_contained(F.transform("news", lambda c: c["text"]), F.transform("olds", lambda c: c["old_text"])))
    pairs = F.zip_with("news", "at", lambda c, k: F.struct(c["chunk_id"].alias("chunk_id"), F.get("olds", k)["old_summary"].alias("within")))
    best = both.select("doc_id", F.explode(F.filter(pairs, lambda x: x["within"].isNotNull())).alias("x")).select("doc_id", "x.*")
    rows = new.join(exact, ["doc_id", "text"], "left").join(best, ["doc_id", "chunk_id"], "left")
    return rows.withColumn("summary", F.coalesce("same", "within", "summary")).select(new.columns)


#: Rows of a bucket that one task writes.
ROWS_OF_FILE = 20_000


class Busy(RuntimeError):
    """Another writer is changing the table."""


#: Partitions of a table by hash of its key.
BUCKETS = 32


@dataclass
class Tables:
    """Tables of documents, chunks and folders as Parquet, partitioned by a hash of their key, and the chunks' index.

    A change of some documents reads and rewrites their buckets only, by Spark's dynamic partition overwrite, and adds
    one segment to the index. Writers of a table take turns: one that meets another waits, then fails. A table is always
    opened with the number of buckets that it was made with.
    """

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _key(schema: T.StructType) -> str:
        return schema[0].name

    def read(self, name: str, schema: T.StructType, keys: list[str] | None = None) -> DataFrame:
        """The table; with ``keys``, their rows, of which only the buckets are read."""
        key = self._key(schema)
        try:
            rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        if keys is not None:
            lits = F.array(*[F.lit(k) for k in keys]).cast(T.ArrayType(schema[0].dataType))
            which = self.spark.range(1).select(F.array_distinct(F.transform(lits, self._bucket_of)).alias("b")).first()["b"]
            rows = rows.filter(F.col("bucket").isin(which) & F.col(key).isin(keys))
        return rows.filter(F.col(key).isNotNull()).select([f.name for f in schema])

    def _bucket_of(self, x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(self.buckets)).cast("int")

    @contextlib.contextmanager
    def _turn(self, name: str, wait: float) -> Iterator[None]:
        """Holds the table's lock: a file that only one writer can create."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_locks/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        until = time.monotonic() + wait
        while True:
            try:
                fs.create(path, False).close()
                break
            except Exception as e:
                if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                    raise
                if time.monotonic() > until:
                    raise Busy(f"{name} is being changed; unlock it if its writer is gone") from e
                time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(path, False)

    def unlock(self, name: str) -> None:
        """Takes away the lock of a writer that died."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_locks/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    def change(self, name: str, schema: T.StructType, of: Callable[[DataFrame], DataFrame], ids: DataFrame | None = None, wait: float = 60.0) -> None:
        """Writes ``of`` the table's rows in place of them; with ``ids`` (a column of keys), only those rows are read, given and replaced."""
        key = self._key(schema)
        with self._turn(name, wait):
            if ids is None:
                which, new = list(range(self.buckets)), of(self.read(name, schema))
            else:
                ids = checkpointed(ids.select(F.col(ids.columns[0]).alias(key)).filter(F.col(key).isNotNull()).distinct())
                which = [r["b"] for r in ids.select(self._bucket(key).alias("b")).distinct().collect()]
                try:
                    held = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{name}")
                    held = held.filter(F.col("bucket").isin(which) & F.col(key).isNotNull()).select([f.name for f in schema])
                except Exception as e:
                    if "PATH_NOT_FOUND" not in str(e):
                        raise
                    held = self.spark.createDataFrame([], schema)
                new = held.join(ids, key, "left_anti").unionByName(of(held.join(ids, key, "left_semi")).select([f.name for f in schema]))
            # a row without a key in each bucket, so that a bucket that has become empty is replaced too
            marks = self.spark.createDataFrame([(b,) for b in which], "bucket int").select("bucket", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
            held = stored(new.select([f.name for f in schema]).filter(F.col(key).isNotNull()))
            parts = max(1, -(-held.count() // (ROWS_OF_FILE * self.buckets)))
            rows = held.withColumn("bucket", self._bucket(key)).unionByName(marks)
            rows.repartition(parts * self.buckets, "bucket", F.pmod(F.hash(key), F.lit(parts))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def write(self, name: str, table: DataFrame) -> None:
        """Replaces the whole table. Its key is the first column of the table's schema."""
        schema = SCHEMAS[name]
        self.change(name, schema, lambda _: table)
        if name == "chunks":
            known = self.segments()._read("lengths", LENGTHS)
            ids = table.select("doc_id")
            self.segments().add(table, ids if known is None else ids.unionByName(known.select("doc_id")))

    def put_chunks(self, chunks: DataFrame, ids: DataFrame) -> None:
        """Replaces all chunks of the documents in ids (doc_id) by those given, in the table and in the index."""
        chunks = checkpointed(chunks)
        self.change("chunks", S.CHUNKS, lambda _: chunks, ids)
        self.segments().add(chunks, ids)

    def patch_chunks(self, patch: DataFrame) -> None:
        """Replaces chunks by those of ``patch`` with their ids, or adds them; the rest of their documents' chunks stays."""
        patch = checkpointed(patch)
        made: list[DataFrame] = []

        def of(old: DataFrame) -> DataFrame:
            made.append(checkpointed(merge_chunks(old, patch)))
            return made[0]

        self.change("chunks", S.CHUNKS, of, patch.select("doc_id"))
        self.segments().add(made[0], patch.select("doc_id"))

    def tidy(self, most: int = 16) -> None:
        """Merges small segments of the index if it has more than ``most``."""
        if self.segments().segments().count() > most:
            self.segments().merge()

    def segments(self) -> Segments:
        """The index of the chunks."""
        return Segments(self.spark, f"{self.path}/index")


SCHEMAS = {"docs": S.DOCS, "chunks": S.CHUNKS, "folders": S.FOLDERS}
