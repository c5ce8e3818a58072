"""Histories in a stream: kept as state that grows by what is appended, and synced exactly once.

``history_stream`` keeps each message of a thread as one entry of a list state, so a batch writes what
came and not the whole history again, and forgets threads by a timer of event time. ``sync_stream``
builds and writes contexts per micro-batch; a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tokenfold.operators.builder import Builder
from tokenfold.operators.thread import sync_all
from tokenfold.sources.history import FLAVOURS

OUTCOMES = "thread_id string, seq long, op string, accepted boolean, version long, n_messages long"

#: Transforms with state need this store, set before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Histories(StatefulProcessor):
    """A thread's version, message count, time of its last write and clock as one value, and its payloads as a list."""

    def __init__(self, flavour: str, ttl_seconds: int):
        self._flavour, self._ttl = flavour, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._head = handle.getValueState("head", "version long, size long, written long, clock long")
        self._payloads = handle.getListState("payloads", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, size, written, clock = self._head.get() if self._head.exists() else (0, 0, None, None)
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out, came, renewed = [], [], False
        for seq, op, expected, payloads, at in zip(frame["seq"], frame["op"], frame["expected_version"], frame["payloads"], frame["at"]):
            payloads = [] if payloads is None else list(payloads)
            clock = int(at) if clock is None else max(clock, int(at))
            if self._ttl and written is not None and clock >= written + self._ttl:
                version, size, written, came, renewed = 0, 0, None, [], True
            idle = op == "append" and not payloads
            accepted = idle or expected == version
            if accepted and not idle:
                if op != "append":
                    came, size, renewed = [], 0, True
                came += payloads if op != "clear" else []
                size = size + len(payloads) if op != "clear" else 0
                version = 0 if self._flavour == "reset" and not size else version + 1
                written = clock
            out.append((key[0], int(seq), op, accepted, version, size))
        if renewed:
            self._payloads.clear()
        if came:
            self._payloads.appendList([(p,) for p in came])
        self._head.update((version, size, written, clock))
        if self._ttl and written is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer((written + self._ttl) // 1000 + 1)
        yield pd.DataFrame(out, columns=["thread_id", "seq", "op", "accepted", "version", "n_messages"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No write came in time: nothing is kept of the thread. What comes later finds version 0 all the same."""
        self._head.clear()
        self._payloads.clear()
        yield from ()

    def close(self) -> None:
        pass


def history_stream(ops: DataFrame, flavour: str = "monotonic", ttl_seconds: int = 0) -> DataFrame:
    """Outcome of each operation of a stream (thread_id, seq, op, expected_version, payloads, and ts with a time to live), in append mode.

    As ``replay``: ``ts`` going back counts as standing still. Operations of a thread must not come out of order over
    batches. With ``ttl_seconds``, ``ops`` needs a watermark on ``ts``, and threads are forgotten once it has passed the
    time of their last write by so much; the outcomes don't depend on when that happens.
    """
    if flavour not in FLAVOURS:
        raise ValueError(f"unknown flavour {flavour}")
    at = F.unix_micros(F.col("ts").cast("timestamp")) if "ts" in ops.columns else F.lit(0).cast("long")
    columns = ["thread_id", "seq", "op", "expected_version", "payloads", at.alias("at"), *(["ts"] if "ts" in ops.columns else [])]
    return ops.select(*columns).groupBy("thread_id").transformWithStateInPandas(
        statefulProcessor=_Histories(flavour, ttl_seconds), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime" if ttl_seconds else "None"
    )


def sync_stream(new: DataFrame, store, builder: Builder, history_block: str, checkpoint: str, sink: Callable[[DataFrame, int], None], stream: str = "sync") -> StreamingQuery:
    """Start a query that syncs the threads of each micro-batch of ``new`` (build_id, pos, message) with ``store``.

    Exactly once: a batch's writes are fenced by ``stream`` and the batch's number, which the log keeps. A batch that
    was committed before a failure is found there when it is run again; its threads aren't built and written anew, and
    only those without a write of that batch are. ``sink`` gets the batch's outcomes and must be idempotent by number.
    """

    def run(batch: DataFrame, number: int) -> None:
        ids = batch.select("build_id").distinct()
        fence = f"{stream}:{number}"
        done = store.fenced(fence)
        left = ids.join(done.select("thread_id").distinct(), F.col("build_id").cast("string") == F.col("thread_id"), "left_anti")
        sink(sync_all(store.with_fence(fence), builder, history_block, batch, left).outcomes, number)

    return new.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
