"""Folders: paths, subtrees, heights, display order, and validated changes.

Folders are a small table with parent links at most five deep; recursion is a recursive query with a depth
bound, so a cycle ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X


def ancestors(folders: DataFrame) -> DataFrame:
    """folder_id, ancestor_id, up (0 for itself): the way to the root; unknown parents end it, and the depth limit a cycle."""
    return folders.sparkSession.sql(
        f"""WITH RECURSIVE way(folder_id, ancestor_id, next_id, up) AS (
          SELECT folder_id, folder_id, parent_id, 0 FROM {{folders}}
          UNION ALL
          SELECT way.folder_id, above.folder_id, above.parent_id, up + 1 FROM way JOIN {{folders}} above ON above.folder_id = next_id
          WHERE above.folder_id <> way.folder_id AND up <= {S.FOLDER_DEPTH})
        SELECT folder_id, ancestor_id, min(up) AS up FROM way GROUP BY folder_id, ancestor_id""",
        folders=folders.select("folder_id", "parent_id"),
    )


def paths(folders: DataFrame) -> DataFrame:
    """folder_id, path (names from the root joined by ' / '), depth (1 at the root)."""
    named = ancestors(folders).join(folders.select(F.col("folder_id").alias("ancestor_id"), "name"), "ancestor_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), "name"))), lambda x: x["name"])
    return named.groupBy("folder_id").agg(F.array_join(parts, " / ").alias("path"), (F.max("up") + 1).alias("depth"))


def subtree(folders: DataFrame, folder_id: str) -> DataFrame:
    """folder_id and down (0 for itself) of a folder and all below it."""
    return ancestors(folders).filter(F.col("ancestor_id") == folder_id).select("folder_id", F.col("up").alias("down"))


def heights(folders: DataFrame) -> DataFrame:
    """folder_id, height: levels in its subtree, itself included."""
    return ancestors(folders).groupBy(F.col("ancestor_id").alias("folder_id")).agg((F.max("up") + 1).alias("height"))


def subtree_docs(folders: DataFrame, docs: DataFrame, folder_id: str | None) -> DataFrame:
    """The documents in a folder or below it; those in no known folder, if it is None."""
    if folder_id is None:
        return docs.join(folders.select("folder_id"), "folder_id", "left_anti")
    return docs.join(subtree(folders, folder_id).select("folder_id"), "folder_id", "left_semi")


def doc_counts(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """folder_id, docs (directly in it), docs_below (in its subtree)."""
    n = docs.groupBy("folder_id").agg(F.count("*").alias("n"))
    below = ancestors(folders).join(n, "folder_id").groupBy(F.col("ancestor_id").alias("folder_id")).agg(F.sum("n").alias("below"))
    return folders.select("folder_id").join(n, "folder_id", "left").join(below, "folder_id", "left").select("folder_id", F.coalesce("n", F.lit(0)).cast("long").alias("docs"), F.coalesce("below", F.lit(0)).cast("long").alias("docs_below"))


def display_order(folders: DataFrame, collation: str = "zh") -> DataFrame:
    """folder_id, depth, place: the tree depth-first, siblings by name; folders with an unknown parent are roots.

    Names are compared by a collation of ICU: letters without regard to accents and case first, Chinese by pinyin.
    """
    known = folders.select(F.col("folder_id").alias("parent_id"), F.lit(True).alias("known"))
    rows = folders.join(known, "parent_id", "left").withColumn("under", F.when(F.col("known"), F.col("parent_id")))
    among = F.row_number().over(Window.partitionBy("under").orderBy(F.collate("name", collation), "folder_id"))
    way = ancestors(folders).join(rows.select(F.col("folder_id").alias("ancestor_id"), among.alias("nth")), "ancestor_id")
    key = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), "nth", "ancestor_id"))), lambda x: F.struct(x["nth"], x["ancestor_id"]))
    placed = way.groupBy("folder_id").agg(key.alias("key"), (F.max("up") + 1).alias("depth"))
    return placed.withColumn("place", F.row_number().over(Window.orderBy("key"))).drop("key")


class FolderError(ValueError):
    """A change that the rules of folders forbid."""


def _one(df: DataFrame, column: str):
    row = df.select(column).first()
    return None if row is None else row[0]


def _checked_name(folders: DataFrame, name: str, parent_id: str | None, but: str | None = None) -> str:
    clean = folders.sparkSession.range(1).select(X.folder_name(F.lit(name))).first()[0]
    if clean is None:
        raise FolderError(f"a folder's name has 1 to {S.FOLDER_NAME} characters")
    same = folders.filter(F.col("parent_id").eqNullSafe(F.lit(parent_id)) & (F.lower("name") == clean.lower()))
    if same.filter(F.col("folder_id") != (but or "")).limit(1).count():
        raise FolderError("a folder with this name is there already")
    return clean


def create(folders: DataFrame, folder_id: str, name: str, parent_id: str | None = None) -> DataFrame:
    """folders with one more; refused below five levels, under an unknown parent, or beside its name."""
    if parent_id is not None:
        depth = _one(paths(folders).filter(F.col("folder_id") == parent_id), "depth")
        if depth is None:
            raise FolderError("the parent folder is unknown")
        if depth + 1 > S.FOLDER_DEPTH:
            raise FolderError(f"folders are at most {S.FOLDER_DEPTH} deep")
    clean = _checked_name(folders, name, parent_id)
    new = folders.sparkSession.range(1).select(F.lit(folder_id).alias("folder_id"), F.lit(clean).alias("name"), F.lit(parent_id).cast("string").alias("parent_id"), F.current_timestamp().alias("created_at"))
    last = folders.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last")).first()[0]
    return folders.unionByName(new.withColumn("ord", F.lit(last + 1).cast("long")))


def rename(folders: DataFrame, folder_id: str, name: str) -> DataFrame:
    row = folders.filter(F.col("folder_id") == folder_id).first()
    if row is None:
        raise FolderError("the folder is unknown")
    clean = _checked_name(folders, name, row["parent_id"], folder_id)
    return folders.withColumn("name", F.when(F.col("folder_id") == folder_id, F.lit(clean)).otherwise(F.col("name")))


def move(folders: DataFrame, folder_id: str, parent_id: str | None) -> DataFrame:
    """folders with one under another parent; refused under itself and beyond five levels. Names may repeat."""
    height = _one(heights(folders).filter(F.col("folder_id") == folder_id), "height")
    if height is None:
        raise FolderError("the folder is unknown")
    depth = 0
    if parent_id is not None:
        if subtree(folders, folder_id).filter(F.col("folder_id") == parent_id).limit(1).count():
            raise FolderError("a folder cannot be moved below itself")
        depth = _one(paths(folders).filter(F.col("folder_id") == parent_id), "depth")
        if depth is None:
            raise FolderError("the parent folder is unknown")
    if depth + height > S.FOLDER_DEPTH:
        raise FolderError(f"folders are at most {S.FOLDER_DEPTH} deep")
    return folders.withColumn("parent_id", F.when(F.col("folder_id") == folder_id, F.lit(parent_id).cast("string")).otherwise(F.col("parent_id")))


def delete(folders: DataFrame, docs: DataFrame, folder_id: str) -> tuple[DataFrame, DataFrame]:
    """folders without one and its subtree, and documents hoisted from there to its parent."""
    row = folders.filter(F.col("folder_id") == folder_id).first()
    if row is None:
        raise FolderError("the folder is unknown")
    gone = subtree(folders, folder_id).select("folder_id", F.lit(True).alias("gone"))
    left = folders.join(gone, "folder_id", "left_anti")
    hoisted = docs.join(gone, "folder_id", "left").withColumn("folder_id", F.when(F.col("gone"), F.lit(row["parent_id"]).cast("string")).otherwise(F.col("folder_id"))).drop("gone")
    return left, hoisted.select(docs.columns)
