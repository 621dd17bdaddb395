"""What the operators of this folder share: staged tables and text splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, where the setting is absent (tests), gets a fresh
    temporary folder; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-stage-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage in a way that outlives lost executors, and gives Catalyst the
    true size of the table, so that it broadcasts only what is really small.
    """
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables that a job uses up itself: each goes when what was made of
    it is written, the rest at the end.  What a job returns is ``staged``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.written = 0

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{self.written}-{name}"
        self.written += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *used: DataFrame) -> None:
        for out, path in self.tables:
            if any(out is u for u in used):
                self._remove(path)
        self.tables = [t for t in self.tables if not any(t[0] is u for u in used)]

    def close(self) -> None:
        self._remove(self.folder)
        self.tables = []

    def _remove(self, path: str) -> None:
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, where 64 MB is usual:
    workers and JVM both keep a batch, for each core, beside what they make of it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns free memory to the system: Python workers outlive their tasks, and
    what one of them keeps is missing to the next operator's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` has about ``most`` bytes in each, or one
    row if that is longer: what a task holds at once does not hang on row counts."""
    for whole in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < whole.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield whole.slice(start, stop - start)
            start = stop


def lower_ascii(col: Column) -> Column:
    """A-Z to lower case, every other character unchanged."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def all_columns(df: DataFrame) -> list[Column]:
    """Every column by its quoted name, whatever signs that has."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(udf: Callable) -> Callable:
    """Keep Catalyst from evaluating an expensive function twice when a filter
    or a projection on its result is moved below the projection that calls it."""
    return udf.asNondeterministic()
