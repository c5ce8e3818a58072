"""A file store whose reads don't grow with its log: snapshots of all threads, and the commits since.

A snapshot holds every thread's version and messages as of one commit, in folders by a hash of the
thread. The manifest is a folder of empty files named by the snapshots they announce; creating one is
what makes a snapshot count, at once and for everybody, and the highest number is the one in force.
Commits that it covers can be deleted once no reader of the snapshot before is left.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.errors import ContextError
from tokenfold.sources import chains
from tokenfold.sources.history import COMMIT, LOGGED, FileHistoryStore
from tokenfold.sources.shared import written

_HEADS = "thread_id string, version long, written timestamp, size long, bucket int"
_ROWS = "thread_id string, pos long, payload string, bucket int"


@dataclass(frozen=True)
class CompactedHistoryStore(FileHistoryStore):
    """``FileHistoryStore`` with snapshots. ``buckets`` is fixed with the first one.

    Loads of one thread read one bucket and the tail; loads of many read what they join. ``snapshot``,
    ``commit`` and ``accepted`` take and give frames, for any number of threads.
    """

    buckets: int = 64

    def bucket(self, thread_id: Column) -> Column:
        return F.pmod(F.xxhash64(thread_id), F.lit(self.buckets)).cast("int")

    def base(self) -> int:
        return max(self._numbers("manifest"), default=0)

    def _held(self, name: str, schema: str) -> DataFrame:
        """Heads or rows of the snapshot in force."""
        number = self.base()
        return self.spark.read.schema(schema).parquet(f"{self.root}/snapshots/{number}/{name}") if number else self.spark.createDataFrame([], schema)

    def _judged(self, heads: DataFrame, tail: DataFrame, look: bool) -> DataFrame:
        """Outcomes of the tail's operations on what the heads say; with ``look``, as of now as well."""
        restored = heads.select(
            "thread_id", F.lit(-1).cast("long").alias("seq"), F.lit(chains.RESTORE).alias("op"), (F.col("version") - 1).alias("expected_version"),
            F.array().cast("array<string>").alias("payloads"), F.col("written").alias("ts"),
        )
        rows = tail.select(*LOGGED.fieldNames()).unionByName(restored)
        if look and self.ttl_seconds:
            # An append of nothing changes nothing, but sees what has expired.
            seen = rows.select("thread_id").distinct().select(
                "thread_id", F.lit((1 << 63) - 1).alias("seq"), F.lit("append").alias("op"), F.lit(0).cast("long").alias("expected_version"),
                F.array().cast("array<string>").alias("payloads"), F.current_timestamp().alias("ts"),
            )
            rows = rows.unionByName(seen)
        return written(chains.outcomes(rows, self.flavour, self.ttl_seconds), "store-judged")

    def _state(self, heads: DataFrame, rows: DataFrame, tail: DataFrame, look: bool = True) -> tuple[DataFrame, DataFrame]:
        """(thread_id, version) and (thread_id, version, pos, payload) of the heads' and the tail's threads."""
        judged = self._judged(heads, tail, look)
        ends = judged.groupBy("thread_id").agg(
            F.max_by("version", "place").alias("version"), F.max_by("empty", "place").alias("empty"), F.max_by("op", F.when(F.col("fresh"), F.col("place"))).alias("began")
        )
        stays = ends.filter(~F.col("empty") & (F.col("began") == chains.RESTORE)).select("thread_id", "version")
        old = rows.join(stays, "thread_id").select("thread_id", "version", "pos", "payload")
        sizes = heads.join(stays, "thread_id", "left_semi").select("thread_id", "size")
        late = chains.histories(judged).join(sizes, "thread_id", "left")
        later = late.select("thread_id", "version", (F.col("pos") + F.coalesce("size", F.lit(0))).alias("pos"), "payload")
        return ends.select("thread_id", "version"), old.unionByName(later)

    def compact(self) -> int:
        """Write a snapshot as of the last settled commit and put it in force; its number."""
        last, first = self._settled(), self.base()
        if last == first:
            return first
        heads, rows, tail = self._held("heads", _HEADS), self._held("rows", _ROWS), self.ops()
        ends, messages = self._state(heads, rows, tail, look=False)
        messages = written(messages, "compacted")
        # Written is the time of the last write that was accepted, which a time to live counts from.
        stamps = tail.select("thread_id", "seq", F.col("ts").alias("written")).unionByName(heads.select("thread_id", F.lit(-1).cast("long").alias("seq"), "written"))
        accepted = self._judged(heads, tail, False).filter("accepted AND (op <> 'append' OR size(payloads) > 0)").select("thread_id", "seq")
        latest = stamps.join(accepted, ["thread_id", "seq"]).groupBy("thread_id").agg(F.max("written").alias("written"))
        sizes = messages.groupBy("thread_id").agg(F.count("*").alias("size"))
        kept = ends.filter("version > 0").join(latest, "thread_id", "left").join(sizes, "thread_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        for name, frame in (("heads", kept), ("rows", messages.drop("version"))):
            dealt = frame.withColumn("bucket", self.bucket(F.col("thread_id")))
            dealt.repartition("bucket", F.pmod(F.xxhash64("thread_id"), F.lit(self.buckets * 8))).write.partitionBy("bucket").parquet(f"{staged}/{name}")
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.root}/snapshots"))
        fs.mkdirs(path(f"{self.root}/manifest"))
        if not fs.exists(path(f"{self.root}/snapshots/{last}")):
            fs.rename(path(staged), path(f"{self.root}/snapshots/{last}"))
        fs.createNewFile(path(f"{self.root}/manifest/{last}"))
        return last

    def expire(self) -> None:
        """Delete commits that the snapshot in force covers, their claims but the last, and earlier snapshots.

        Call it when no reader or writer is left that began before the snapshot came into force.
        """
        fs, path = self._fs()
        base = self.base()
        for name, pattern, limit in (("log", "commit={}", base), ("claims", "{}", base), ("snapshots", "{}", base - 1), ("manifest", "{}", base - 1)):
            for number in self._numbers(name):
                if number <= limit:
                    fs.delete(path(f"{self.root}/{name}/{pattern.format(number)}"), True)

    def snapshot(self, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(thread_id, version) and (thread_id, version, pos, message) of ``threads`` (thread_id) that were ever written."""
        ends, messages = self.payloads(threads)
        return ends, messages.select("thread_id", "version", "pos", self.decode(F.col("payload")).alias("message"))

    def payloads(self, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``snapshot`` with the payloads as they are stored."""
        heads, rows, tail = (f.join(threads, "thread_id", "left_semi") for f in (self._held("heads", _HEADS), self._held("rows", _ROWS), self.ops()))
        return self._state(heads, rows, tail)

    def accepted(self, number: int, threads: DataFrame) -> DataFrame:
        """(thread_id, seq, accepted) of the operations of commit ``number``, on ``threads``."""
        heads, tail = (f.join(threads, "thread_id", "left_semi") for f in (self._held("heads", _HEADS), self.ops()))
        judged = self._judged(heads, tail, False)
        return judged.filter(F.col("seq").between(number * COMMIT, (number + 1) * COMMIT - 1)).select("thread_id", F.col("seq") - number * COMMIT, "accepted").toDF("thread_id", "seq", "accepted")

    def fenced(self, fence: str) -> DataFrame:
        """(thread_id, seq) of the accepted operations that were committed as work of ``fence``, in the log since the snapshot in force."""
        tail = self.ops()
        mine = written(tail.filter(F.col("fence") == fence).select("thread_id", "seq"), "fenced")
        threads = mine.select("thread_id").distinct()
        heads, rows = (f.join(threads, "thread_id", "left_semi") for f in (self._held("heads", _HEADS), tail))
        return mine.join(self._judged(heads, rows, False).filter("accepted").select("thread_id", "seq"), ["thread_id", "seq"])

    def _own(self, thread_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Heads, rows and tail of one thread: its bucket and the commits since."""
        bucket = self.spark.range(1).select(self.bucket(F.lit(thread_id))).first()[0]
        mine = F.col("thread_id") == thread_id
        heads, rows = (self._held(n, s).filter((F.col("bucket") == bucket) & mine) for n, s in (("heads", _HEADS), ("rows", _ROWS)))
        return heads, rows, self.ops().filter(mine)

    def load(self, thread_id: str) -> tuple[list, int]:
        ends, messages = self._state(*self._own(thread_id))
        head = ends.first()
        found = messages.orderBy("pos").select(self.decode(F.col("payload")).alias("message")).collect()
        return [r.message for r in found], head.version if head else 0

    def _accepts(self, thread_id: str, seq: int) -> bool:
        heads, _, tail = self._own(thread_id)
        return self._judged(heads, tail, False).filter(F.col("seq") == seq).first().accepted

    def state(self) -> DataFrame:
        raise ContextError("INVALID_CONFIG", "a compacted store has snapshot() in place of one row a thread")
