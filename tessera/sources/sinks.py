"""Exports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def export_names(docs: DataFrame) -> DataFrame:
    """doc_id, base, md_file, mindmap_file: names that do not clash.

    Of documents with equal names the first keeps it, the others carry the start of their id, and the whole id where
    that clashes again.
    """
    base = X.sanitize_base(F.coalesce("original_name", "name"))
    plain = F.when(base == "", F.concat(F.lit("doc-"), F.substring("doc_id", 1, 8))).otherwise(base)
    nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("doc_id"))
    rows = docs.select("doc_id", plain.alias("plain")).withColumn("own", nth("plain") == 1)
    short = F.concat("plain", F.lit("-"), F.substring("doc_id", 1, 6))
    rows = rows.withColumn("base", F.when(F.col("own"), F.col("plain")).otherwise(short))
    again = Window.partitionBy("base").orderBy(F.desc("own"), "doc_id")
    whole = F.concat("plain", F.lit("-"), F.col("doc_id"))
    rows = rows.withColumn("base", F.when(F.row_number().over(again) == 1, F.col("base")).otherwise(whole))
    return rows.select("doc_id", "base", F.concat("base", F.lit(".md")).alias("md_file"), F.concat("base", F.lit(".mindmap.md")).alias("mindmap_file"))


def write_exports(exports: DataFrame, path: str) -> None:
    """exports: file, content -> one text file in a folder named after each file, by Spark's writer."""
    exports.select("file", F.col("content").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").option("lineSep", "\n").text(path)


def safe_file(file: Column | str) -> Column:
    """Whether a stored name stays in the exports' folder."""
    f = F.col(file) if isinstance(file, str) else file
    return f.isNotNull() & (f != "") & ~F.contains(f, F.lit("/")) & ~F.contains(f, F.lit("\\")) & ~f.startswith(".")


def read_exports(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """files: file -> file, content of those that were written; unsafe and missing names are left out."""
    wanted = files.filter(safe_file("file")).select("file").distinct()
    held = spark.read.schema("value string, file string").text(path, wholetext=True).select("file", "value", F.col("_metadata.file_path").alias("part"))
    parts = held.join(wanted, "file", "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda x: x["value"])
    return parts.groupBy("file").agg(F.regexp_replace(F.array_join(listed, ""), "\n$", "").alias("content"))


def remove_exports(spark: SparkSession, path: str, files: DataFrame) -> None:
    """Removes the folders of some exports; unsafe names are left alone. The names are one document's or a few."""
    for row in files.filter(safe_file("file")).select("file").distinct().toLocalIterator():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/file={row['file']}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
