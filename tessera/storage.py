"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines see; one of its own where that is unset and all run in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return top or _own_folder()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, stem: str = "table") -> str:
    """A path in the shared folder; what is there is removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(remove)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as compressed Parquet in the shared folder and read back, for larger tables."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows as a table of the driver's, for which no executor starts Python."""
    arrow = to_arrow_schema(schema)
    cols = list(zip(*rows, strict=True)) or [[]] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow), schema=schema)


#: Bytes of an Arrow batch that goes to Python, unless the session has a bound of its own; Spark's default is 64 MB.
BATCH_BYTES = 2_000_000
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Has batches for Python hold BATCH_BYTES in this session, for files that are several times as large once they are read."""
    if spark.conf.get(_BATCHES) == f"{1 << 26}b":
        spark.conf.set(_BATCHES, f"{BATCH_BYTES}b")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it has fewer partitions than there are cores: one small file is one task else.

    A table of more partitions is left as it is, whatever its size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
