"""Streams of history operations and of new messages, over micro-batches, restarts and batches run again."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tests.test_assembly import message
from tests.test_stores import ROW, _texts
from tokenfold.functions.counters import FixedCounter
from tokenfold.functions.messages import text_message
from tokenfold.operators.builder import Builder
from tokenfold.operators.strategies import DropHead, Strict
from tokenfold.sources.chains import outcomes
from tokenfold.sources.compacted import CompactedHistoryStore
from tokenfold.streaming.threads import STATE_STORE, history_stream, sync_stream

OPS = "thread_id string, seq long, op string, expected_version long, payloads array<string>, ts timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def state_store(spark):
    held = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("flavour, ttl", [("monotonic", 0), ("reset", 90)])
def test_stream_equals_batch_replay_over_batches_and_a_restart(spark, tmp_path, state_store, flavour, ttl):
    chance, at, seq, all_rows = random.Random(4), {}, 0, []
    source, sink, place = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    for batch in range(3):
        rows = []
        for _ in range(25):
            thread = f"t{chance.randrange(3)}"
            expected = at.get(thread, 0) if chance.random() < 0.7 else chance.randrange(3)
            op = chance.choice(["append", "append", "save", "clear"])
            payloads = None if op == "clear" else [f"m{seq}"] * chance.randrange(3)
            at[thread] = at.get(thread, 0) + (expected == at.get(thread, 0))
            rows.append((thread, seq, op, expected, payloads, START + datetime.timedelta(seconds=seq * 20)))
            seq += 1
        all_rows += rows
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(source)
        # Each batch is a query of its own, which goes on from the checkpoint.
        ops = spark.readStream.schema(OPS).parquet(source).withWatermark("ts", "0 seconds")
        query = history_stream(ops, flavour, ttl).writeStream.format("parquet").option("path", sink).option("checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination(100)
    got = {(r.thread_id, r.seq): (r.accepted, r.version) for r in spark.read.parquet(sink).collect()}
    wanted = {(r.thread_id, r.seq): (r.accepted, r.version) for r in outcomes(spark.createDataFrame(all_rows, OPS), flavour, ttl).collect()}
    assert got == wanted and len(wanted) == 75


def test_synced_stream_writes_each_batch_once(spark, tmp_path):
    store = CompactedHistoryStore(spark, str(tmp_path / "store"))
    builder = Builder(100, FixedCounter(10)).add_block("system", Strict(), [text_message("system", "hi")]).add_block("history", DropHead(), [])
    source, told, failures = str(tmp_path / "in"), {}, [1]

    def sink(frame, number):
        told[number] = sorted((r.build_id, r.action) for r in frame.collect())
        if number == 0 and failures:
            failures.pop()
            raise RuntimeError("the sink fails after the batch's writes")

    def run():
        new = spark.readStream.schema(ROW).parquet(source)
        query = sync_stream(new, store, builder, "history", str(tmp_path / "at"), sink)
        query.processAllAvailable()
        query.stop()

    spark.createDataFrame([(1, 0, message("user", "a")), (2, 0, message("user", "b"))], ROW).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="sink fails"):
        run()
    assert told[0] == [(1, "append"), (2, "append")]
    run()
    assert told[0] == [] and _texts(store.load("1")[0]) == ["a"] and _texts(store.load("2")[0]) == ["b"]
    spark.createDataFrame([(1, 0, message("user", "c"))], ROW).coalesce(1).write.mode("append").parquet(source)
    run()
    assert told[1] == [(1, "append")] and _texts(store.load("1")[0]) == ["a", "c"] and store.load("2")[1] == 1
    assert store.fenced("sync:0").count() == 2 and store.fenced("sync:1").count() == 1 and store.fenced("other").count() == 0
