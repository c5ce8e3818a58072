"""History as a Spark data source: ``spark.read.format("tokenfold_history").load(root)``.

Rows are the messages of a compacted store's snapshot in force, a partition a bucket. The option
``threads``, a JSON list, restricts the partitions to those threads' buckets; ``thread_history`` sets it.
(Spark 4.1 keeps a reader's pushed filters for every later use of a loaded frame, so that filters are
not pushed here: a frame that is filtered in two ways would lack rows.) The writer appends a
commit: its tasks stage Parquet files, and the commit claims a number and moves them into the log, as
``FileHistoryStore`` does; an abort deletes what was staged. Commits since the snapshot are not read
here, as replaying them is a job of its own (``CompactedHistoryStore.snapshot``).
"""

from __future__ import annotations

import glob
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = "thread_id string, version long, pos long, payload string"
FORMAT = "tokenfold_history"


def _numbers(folder: str) -> list[int]:
    return [int(name.rpartition("=")[2]) for name in (os.listdir(folder) if os.path.isdir(folder) else ()) if not name.startswith(".")]


@dataclass
class Bucket(InputPartition):
    """A bucket's files of the snapshot in force, and the threads asked for (None: all)."""

    number: int
    heads: tuple[str, ...]
    rows: tuple[str, ...]
    threads: tuple[str, ...] | None

    def __init__(self, number: int, heads: tuple[str, ...], rows: tuple[str, ...], threads: tuple[str, ...] | None):
        super().__init__(number)
        self.number, self.heads, self.rows, self.threads = number, heads, rows, threads


def bucket_of(thread_id: str, buckets: int) -> int:
    """Spark's ``pmod(xxhash64(thread_id), buckets)``."""
    import xxhash

    held = xxhash.xxh64_intdigest(thread_id.encode(), 42)
    return (held - (1 << 64) if held >> 63 else held) % buckets


class HistoryReader(DataSourceReader):
    def __init__(self, root: str, buckets: int, threads: set[str] | None):
        self.root, self.buckets, self.threads = root, buckets, threads

    def partitions(self) -> list[InputPartition]:
        base = max(_numbers(f"{self.root}/manifest"), default=0)
        wanted = None if self.threads is None else {bucket_of(t, self.buckets) for t in self.threads}
        found = []
        for folder in sorted(glob.glob(f"{self.root}/snapshots/{base}/heads/bucket=*")) if base else ():
            number = int(folder.rpartition("=")[2])
            if wanted is None or number in wanted:
                heads, rows = (tuple(sorted(glob.glob(f"{self.root}/snapshots/{base}/{kind}/bucket={number}/*.parquet"))) for kind in ("heads", "rows"))
                found.append(Bucket(number, heads, rows, None if self.threads is None else tuple(sorted(self.threads))))
        return found

    def read(self, partition: Bucket) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        if not getattr(partition, "rows", None):  # without buckets Spark asks for one partition of nothing
            return
        only = None if partition.threads is None else pc.field("thread_id").isin(list(partition.threads))
        heads = ds.dataset(list(partition.heads), format="parquet").to_table(columns=["thread_id", "version"], filter=only)
        versions = dict(zip(heads.column(0).to_pylist(), heads.column(1).to_pylist()))
        for batch in ds.dataset(list(partition.rows), format="parquet").to_batches(columns=["thread_id", "pos", "payload"], filter=only):
            for thread_id, pos, payload in zip(*(c.to_pylist() for c in batch.columns)):
                yield thread_id, versions[thread_id], pos, payload


@dataclass
class Staged(WriterCommitMessage):
    path: str


class HistoryWriter(DataSourceArrowWriter):
    """Operations (thread_id, seq, op, expected_version, payloads, ts) as one commit of the log."""

    def __init__(self, root: str):
        self.root, self.staged = root, f"{root}/staged/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.parquet as pq

        os.makedirs(self.staged, exist_ok=True)
        path = f"{self.staged}/part-{uuid.uuid4().hex}.parquet"
        writer = None
        for batch in iterator:
            writer = writer or pq.ParquetWriter(path, batch.schema)
            writer.write_table(pa.Table.from_batches([batch]))
        if writer:
            writer.close()
        return Staged(path)

    def commit(self, messages: list) -> None:
        # What a failed attempt of a task left behind isn't in a message, and goes.
        kept = {m.path for m in messages if m is not None}
        os.makedirs(self.staged, exist_ok=True)
        for path in glob.glob(f"{self.staged}/*.parquet"):
            if path not in kept:
                os.remove(path)
        for name in ("claims", "log"):
            os.makedirs(f"{self.root}/{name}", exist_ok=True)
        number = max([*_numbers(f"{self.root}/log"), *_numbers(f"{self.root}/manifest")], default=0) + 1
        while True:
            try:
                os.close(os.open(f"{self.root}/claims/{number}", os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                number += 1
        os.rename(self.staged, f"{self.root}/log/commit={number}")

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class HistoryDataSource(DataSource):
    """Options: ``buckets`` as of the store (64). The folder must be one that driver and executors see by the same path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def _root(self) -> str:
        return re.sub("^file:(//)?", "", self.options["path"]).rstrip("/")

    def reader(self, schema: StructType) -> DataSourceReader:
        threads = self.options.get("threads")
        return HistoryReader(self._root(), int(self.options.get("buckets", "64")), None if threads is None else set(json.loads(threads)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a history is appended to")
        return HistoryWriter(self._root())


def thread_history(spark: SparkSession, root: str, threads: list[str], buckets: int = 64) -> DataFrame:
    """The rows of some threads, from their buckets only."""
    spark.dataSource.register(HistoryDataSource)
    return spark.read.format(FORMAT).option("buckets", buckets).option("threads", json.dumps(threads)).load(root)
