"""Conversation history as a log of conditional operations.

A write is a row with the version that its writer saw. Replaying a thread's rows in order accepts
a row only if that version is still the thread's; other rows are conflicts and change nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.errors import Cancelled, ContextError, classify
from tokenfold.functions.codecs import BASE64, JSON, Codec, unpack
from tokenfold.functions.messages import MESSAGE, from_payload

OPS = T.StructType(
    [
        T.StructField("thread_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()),
        T.StructField("expected_version", T.LongType()), T.StructField("payloads", T.ArrayType(T.StringType())),
    ]
)

#: ``monotonic``: every accepted write bumps the version. ``reset``: a thread without messages is
#: forgotten, and its version is 0 again.
FLAVOURS = ("monotonic", "reset")

def _step(flavour: str, ttl_seconds: int):
    def apply(at: Column, op: Column) -> Column:
        expired = F.lit(False)
        if ttl_seconds > 0:
            expired = at["written"].isNotNull() & (at["written"] + F.expr(f"INTERVAL {ttl_seconds} SECONDS") <= op["ts"])
        none = F.array().cast("array<string>")
        version = F.when(expired, F.lit(0).cast("long")).otherwise(at["version"])
        messages = F.when(expired, none).otherwise(at["messages"])
        exists = F.when(expired, F.lit(False)).otherwise(at["exists"])
        payloads = F.coalesce(op["payloads"], none)
        idle = (op["op"] == "append") & (F.size(payloads) == 0)
        accepted = idle | (op["expected_version"] == version)
        emptied = (op["op"] == "clear") | ((op["op"] == "save") & (F.size(payloads) == 0))
        writes = accepted & ~idle
        after = F.when(op["op"] == "append", F.concat(messages, payloads)).when(emptied, none).otherwise(payloads)
        bumped = version + 1
        if flavour == "reset":
            bumped = F.when(emptied, F.lit(0).cast("long")).otherwise(version + 1)
        held = F.when(emptied, F.lit(flavour == "monotonic")).otherwise(F.lit(True))
        return F.struct(
            F.when(writes, bumped).otherwise(version).alias("version"),
            F.when(writes, after).otherwise(messages).alias("messages"),
            F.when(writes, held).otherwise(exists).alias("exists"),
            F.when(writes, op["ts"]).when(expired, F.lit(None).cast("timestamp")).otherwise(at["written"]).alias("written"),
            F.concat(
                at["outcomes"],
                F.array(F.struct(op["seq"].alias("seq"), accepted.alias("accepted"), F.when(writes, bumped).otherwise(version).alias("version"))),
            ).alias("outcomes"),
        )

    return apply


def replay(ops: DataFrame, flavour: str = "monotonic", ttl_seconds: int = 0) -> DataFrame:
    """One row per thread: thread_id, version, messages (payloads in order) and ``outcomes`` per op.

    Rows apply in order of ``seq``. With ``ttl_seconds`` (0: never) ops need a timestamp ``ts``, and
    a thread not written for that long has expired: version 0 and no messages.
    """
    if flavour not in FLAVOURS:
        raise ValueError(f"unknown flavour {flavour}")
    if ttl_seconds < 0:
        raise ValueError("the time to live may not be negative")
    ts = F.col("ts").cast("timestamp") if "ts" in ops.columns else F.lit(None).cast("timestamp")
    op = F.struct("seq", "op", "expected_version", "payloads", ts.alias("ts"))
    gathered = ops.groupBy("thread_id").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    outcome = "array<struct<seq:bigint,accepted:boolean,version:bigint>>"
    start = F.struct(
        F.lit(0).cast("long").alias("version"), F.array().cast("array<string>").alias("messages"), F.lit(False).alias("exists"),
        F.lit(None).cast("timestamp").alias("written"), F.array().cast(outcome).alias("outcomes"),
    )
    return gathered.select("thread_id", F.aggregate("ops", start, _step(flavour, ttl_seconds)).alias("end")).select("thread_id", "end.*")


def loaded(replayed: DataFrame, decode: Callable[[Column], Column] = from_payload) -> DataFrame:
    """History rows (thread_id, version, pos, message) of replayed threads."""
    rows = replayed.select("thread_id", "version", F.posexplode("messages").alias("pos", "payload"))
    return rows.select("thread_id", "version", F.col("pos").cast("long").alias("pos"), decode(F.col("payload")).alias("message"))


#: Operations of a commit are numbered from the commit's number times this.
COMMIT = 1 << 32

#: What a store keeps of each op: when it was written is what a time to live counts from.
LOGGED = T.StructType([*OPS.fields, T.StructField("ts", T.TimestampType())])

#: Besides, which unit of work a commit belongs to, if its writer says so.
FENCED = T.StructType([*LOGGED.fields, T.StructField("fence", T.StringType())])


@dataclass(frozen=True)
class FileHistoryStore:
    """An op log in a folder of any file system that Spark reads.

    A commit is a folder of Parquet files. Its number is claimed by creating a file that must not
    exist; the claimant then moves its folder into the log. A commit counts once every lower number
    is settled, so no commit can appear before one that was already judged. A claim that stays
    unsettled for ``patience`` seconds is voided by whoever waits for it: a folder that says so is
    moved to its place, and a claimant who comes later finds it there and fails as UNAVAILABLE.
    """

    spark: SparkSession
    root: str
    flavour: str = "monotonic"
    ttl_seconds: int = 0
    patience: float = 10.0
    fence: str | None = None
    codec: Codec = JSON
    readable: tuple[Codec, ...] = (JSON, BASE64)

    def decode(self, payload: Column) -> Column:
        """The message of a payload, by whichever codec it was written."""
        return unpack(payload, {*self.readable, self.codec})

    def with_fence(self, fence: str) -> FileHistoryStore:
        """The store, with commits that are marked as work of ``fence``."""
        return replace(self, fence=fence)

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self, name: str) -> set[int]:
        fs, path = self._fs()
        folder = path(f"{self.root}/{name}")
        return {int(s.getPath().getName().rpartition("=")[2]) for s in fs.listStatus(folder)} if fs.exists(folder) else set()

    def _settled(self) -> int:
        """The number up to which every claim has its place in the log."""
        known, last = self._numbers("log"), self.base()
        while last + 1 in known:
            last += 1
        return last

    def base(self) -> int:
        """The number up to which commits aren't read from the log any more."""
        return 0

    def _void(self, number: int) -> None:
        """Settle a claim as void, unless its folder has come meanwhile."""
        fs, path = self._fs()
        staged = path(f"{self.root}/staged/{uuid.uuid4().hex}")
        fs.mkdirs(staged)
        fs.createNewFile(path(staged, "_VOID"))
        # A hint for readers, who then ask whether the folder in the log is this one.
        fs.mkdirs(path(f"{self.root}/void"))
        fs.createNewFile(path(f"{self.root}/void/{number}"))
        if not fs.exists(path(f"{self.root}/log/commit={number}")):
            fs.rename(staged, path(f"{self.root}/log/commit={number}"))

    def _is_void(self, number: int) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.root}/log/commit={number}/_VOID"))

    def commit(self, ops: DataFrame) -> int:
        """Add a batch of ops to the log; whether each is accepted follows from its version."""
        fs, path = self._fs()
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        stamped = ops if "ts" in ops.columns else ops.withColumn("ts", F.current_timestamp())
        stamped.select(*LOGGED.fieldNames(), F.lit(self.fence).cast("string").alias("fence")).write.parquet(staged)
        number = self._claim()
        self._move(staged, number)
        deadline = time.monotonic() + self.patience
        while (last := self._settled()) < number:
            if time.monotonic() > deadline:
                self._void(last + 1)
            else:
                time.sleep(0.05)
        return number

    def _claim(self) -> int:
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.root}/claims"))
        fs.mkdirs(path(f"{self.root}/log"))
        number = self._settled() + 1
        while not fs.createNewFile(path(f"{self.root}/claims/{number}")):
            number += 1
        return number

    def _move(self, staged: str, number: int) -> None:
        fs, path = self._fs()
        if not fs.rename(path(staged), path(f"{self.root}/log/commit={number}")) or self._is_void(number):
            raise ContextError("UNAVAILABLE", f"commit {number} was voided or could not be moved")

    def ops(self) -> DataFrame:
        """All commits that count after ``base``, in one scan of their folders, with ``seq`` in order of commits."""
        first, last = self.base(), self._settled()
        if first == last:
            return self.spark.createDataFrame([], FENCED)
        void = {k for k in self._numbers("void") if self._is_void(k)}
        paths = [f"{self.root}/log/commit={k}" for k in range(first + 1, last + 1) if k not in void]
        if not paths:
            return self.spark.createDataFrame([], FENCED)
        dated = T.StructType([*FENCED.fields, T.StructField("commit", T.LongType())])
        rows = self.spark.read.schema(dated).option("basePath", f"{self.root}/log").parquet(*paths)
        return rows.withColumn("seq", F.col("commit") * COMMIT + F.col("seq")).drop("commit")

    def state(self) -> DataFrame:
        return replay(self.ops(), self.flavour, self.ttl_seconds)

    def _thread(self, thread_id: str) -> DataFrame:
        return replay(self.ops().filter(F.col("thread_id") == thread_id), self.flavour, self.ttl_seconds)

    def load(self, thread_id: str) -> tuple[list, int]:
        """A thread's messages and version; none and 0 if it was never written or has expired."""
        own = self._thread(thread_id)
        if self.ttl_seconds:
            own = own.filter(F.col("written") + F.expr(f"INTERVAL {self.ttl_seconds} SECONDS") > F.current_timestamp())
        head = own.select("version").first()
        rows = loaded(own, self.decode).orderBy("pos").select("message").collect()
        return [r.message for r in rows], head.version if head else 0

    def _write(self, op: str, thread_id: str, expected: int, messages: list) -> None:
        if op == "append" and not messages:
            return
        frame = self.spark.createDataFrame([(m,) for m in messages], T.StructType([T.StructField("message", MESSAGE)]))
        payloads = [r[0] for r in frame.select(self.codec.pack(F.col("message"))).collect()] if messages else []
        number = self.commit(self.spark.createDataFrame([(thread_id, 0, op, expected, payloads)], OPS))
        seq = number * COMMIT
        if not self._accepts(thread_id, seq):
            raise ContextError("HISTORY_VERSION_CONFLICT", thread_id)

    def _accepts(self, thread_id: str, seq: int) -> bool:
        return self._thread(thread_id).select(F.inline("outcomes")).filter(F.col("seq") == seq).first().accepted

    def append(self, thread_id: str, expected: int, messages: list) -> None:
        self._write("append", thread_id, expected, messages)

    def save(self, thread_id: str, expected: int, messages: list | None) -> None:
        self._write("save", thread_id, expected, messages or [])

    def clear(self, thread_id: str, expected: int) -> None:
        self._write("clear", thread_id, expected, [])


class ResilientStore:
    """A store whose calls are tried again while they fail as ``UNAVAILABLE``: up to five times,
    after 10 ms at first and twice as long each time."""

    RETRIES, FIRST_WAIT = 5, 0.01

    def __init__(self, store, sleep: Callable[[float], None] = time.sleep):
        self._store, self._sleep = store, sleep

    def _again(self, call: Callable):
        wait = self.FIRST_WAIT
        for left in range(self.RETRIES, -1, -1):
            try:
                return call()
            except Cancelled:
                raise
            except Exception as error:
                known = classify(error)
                if not left or not isinstance(known, ContextError) or known.code != "UNAVAILABLE":
                    raise known from None
                self._sleep(wait)
                wait *= 2

    def load(self, thread_id: str):
        return self._again(lambda: self._store.load(thread_id))

    def append(self, thread_id: str, expected: int, messages: list):
        return self._again(lambda: self._store.append(thread_id, expected, messages))

    def save(self, thread_id: str, expected: int, messages: list | None):
        return self._again(lambda: self._store.save(thread_id, expected, messages))

    def clear(self, thread_id: str, expected: int):
        return self._again(lambda: self._store.clear(thread_id, expected))


MAX_SYNC_ROUNDS = 32


def sync_thread(store, thread_id: str, build: Callable[[list], tuple[list, str, list]]):
    """Load, build and write one thread, again from the start on a conflict, up to 32 times.

    ``build`` gets the stored messages and returns the context, the action and the messages to write.
    """
    if store is None or not thread_id:
        raise ContextError("INVALID_THREAD_CONFIG")
    for _ in range(MAX_SYNC_ROUNDS):
        messages, version = store.load(thread_id)
        context, action, out = build(messages)
        try:
            if action == "append":
                store.append(thread_id, version, out)
            elif action in ("save", "save_empty"):
                store.save(thread_id, version, out)
            return context
        except ContextError as error:
            if error.code != "HISTORY_VERSION_CONFLICT":
                raise
    raise ContextError("HISTORY_VERSION_CONFLICT", f"{MAX_SYNC_ROUNDS} rounds")
