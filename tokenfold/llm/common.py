"""Shared plumbing of the training-data operators: tables, shared scratch space, hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the contracts: space, and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by its path under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine takes its warehouse's folder, which is made and set
    as checkpoint directory; a cluster must name a folder.
    """
    context = spark.sparkContext
    held = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not held:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tokenfold-shared"
    if not context.getCheckpointDir():
        context.setCheckpointDir(held)
    return held


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tokenfold/{name}-{uuid.uuid4().hex}"


#: While a table is written: its shuffle files go as soon as it is, since nothing else reads them.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for one eager action."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again; ``conf`` holds for the writing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, _WRITING | (conf or {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that are deleted when the block ends.

    What leaves the block must itself be written, elsewhere: no plan may read these tables afterwards.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths, self._names = spark, [], []

    def written(self, df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
        """Like ``written``, for the block."""
        path = scratch_path(self._spark, name)
        self._paths.append(path)
        with settings(self._spark, _WRITING | (conf or {})):
            df.write.option("compression", "zstd").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, column: str, count: int, conf: dict[str, str] | None = None) -> DataFrame:
        """``written`` in ``count`` buckets by ``column``, for joins on it that shuffle neither side; ``conf`` holds for the writing."""
        path = scratch_path(self._spark, name)
        known_as = f"tokenfold_{path.rpartition('/')[2].replace('-', '_')}"
        self._paths.append(path)
        self._names.append(known_as)
        with settings(self._spark, _WRITING | (conf or {})):
            writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
            writer.bucketBy(count, column).saveAsTable(known_as)
        return self._spark.table(known_as)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in self._names:
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")
        context = self._spark.sparkContext
        for path in self._paths:
            held = context._jvm.org.apache.hadoop.fs.Path(path)
            held.getFileSystem(context._jsc.hadoopConfiguration()).delete(held, True)


def written_in_buckets(df: DataFrame, name: str, column: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Like ``written``, in as many buckets by ``column`` as a shuffle has partitions.

    A join on that column then reads the table where it lies and shuffles the other side only.
    ``conf`` are settings for the writing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    catalog_name = f"tokenfold_{path.rpartition('/')[2].replace('-', '_')}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, _WRITING | (conf or {})):
        writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
        writer.bucketBy(count, column).saveAsTable(catalog_name)
    return spark.table(catalog_name)


def release() -> None:
    """Give freed memory back to the system, as Python workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for ``mapInArrow`` that releases memory when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))
