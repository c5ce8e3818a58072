"""Compacted logs and the sync of many threads at once."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_assembly import message
from tokenfold.errors import ContextError
from tokenfold.functions.counters import FixedCounter
from tokenfold.functions.messages import MESSAGE, text_message
from tokenfold.operators.builder import Builder
from tokenfold.operators.strategies import DropHead, Strict
from tokenfold.operators.thread import build_context, sync, sync_all
from tokenfold.sources.compacted import CompactedHistoryStore
from tokenfold.sources.history import OPS, FileHistoryStore

ROW = T.StructType([T.StructField("build_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("message", MESSAGE)])


def _texts(rows):
    return [r.Content[0].text for r in rows]


def _writes(spark, rows: list):
    """Operations of (thread, op, expected, texts)."""
    made = spark.createDataFrame([(t, k, op, e, texts) for k, (t, op, e, texts) in enumerate(rows)], "thread_id string, seq long, op string, expected_version long, texts array<string>")
    return made.withColumn("payloads", F.transform("texts", lambda x: F.to_json(text_message("user", x)))).drop("texts")


def _all(store, spark, threads):
    heads, rows = store.snapshot(spark.createDataFrame([(t,) for t in threads], "thread_id string"))
    held = {r.thread_id: (r.version, []) for r in heads.collect()}
    for r in sorted(rows.collect(), key=lambda r: (r.thread_id, r.pos)):
        assert r.pos == len(held[r.thread_id][1]) and r.version == held[r.thread_id][0]
        held[r.thread_id][1].append(r.message.Content[0].text)
    return held


def test_compacted_store_equals_its_whole_log(spark, tmp_path):
    chance, versions = random.Random(6), {}
    store = CompactedHistoryStore(spark, str(tmp_path / "store"), buckets=4)
    plain = FileHistoryStore(spark, str(tmp_path / "plain"))
    threads = [f"t{k}" for k in range(12)]
    for commit in range(4):
        rows = []
        for k in range(30):
            t = chance.choice(threads)
            expected = versions.get(t, 0) if chance.random() < 0.8 else 9
            op = chance.choice(["append", "append", "save", "clear"])
            rows.append((t, op, expected, [] if op == "clear" else [f"{commit}.{k}"]))
            versions[t] = versions.get(t, 0) + (expected == versions.get(t, 0))
        for s in (store, plain):
            s.commit(_writes(spark, rows))
        if commit in (0, 2):
            assert store.compact() == commit + 1
            store.expire()
    wanted = {r.thread_id: (r.version, [p.split('"text":"')[1].split('"')[0] for p in r.messages]) for r in plain.state().collect()}
    assert _all(store, spark, threads) == wanted
    assert store._numbers("log") == {4} and store._numbers("snapshots") == {3} and store.base() == 3
    rows, version = store.load("t3")
    assert (version, _texts(rows)) == wanted["t3"]
    heads = store._own("t3")[0]
    assert any("PartitionFilters: [isnotnull(bucket" in line for line in heads._jdf.queryExecution().toString().splitlines())
    store.append("t3", version, [message("user", "more")])
    with pytest.raises(ContextError) as error:
        store.append("t3", version, [message("user", "stale")])
    assert error.value.code == "HISTORY_VERSION_CONFLICT"
    assert _texts(store.load("t3")[0])[-1] == "more" and store.load("never") == ([], 0)


def test_expired_threads_are_gone_from_snapshots(spark, tmp_path):
    store = CompactedHistoryStore(spark, str(tmp_path / "store"), ttl_seconds=3600)
    store.commit(_writes(spark, [("old", "append", 0, ["a"]), ("live", "append", 0, ["b"])]).withColumn("ts", F.when(F.col("thread_id") == "old", F.lit(datetime.datetime(2024, 1, 1))).otherwise(F.current_timestamp())))
    for _ in range(2):
        assert store.load("old") == ([], 0) and store.load("live")[1] == 1
        store.compact()
    store.append("old", 0, [message("user", "c")])
    assert (_texts(store.load("old")[0]), store.load("old")[1]) == (["c"], 1)


class _Crossed:
    """A store in which another writer comes before each of the first commits, on every third thread and then every ninth."""

    def __init__(self, store, spark):
        self._store, self._spark, self._commits = store, spark, 0

    def __getattr__(self, name):
        return getattr(self._store, name)

    def commit(self, ops):
        self._commits += 1
        every = 3**self._commits
        if self._commits <= 2:
            id_ = F.col("thread_id").cast("long")
            crossing = ops.filter(id_ % every == 0).withColumns({"op": F.lit("append"), "payloads": F.array(F.to_json(text_message("user", F.lit(f"other{self._commits}"))))})
            self._store.commit(crossing)
        return self._store.commit(ops)


def test_many_threads_end_as_sequential_runs_would(spark, tmp_path):
    count = 10_000
    store = CompactedHistoryStore(spark, str(tmp_path / "store"))
    ids = spark.range(count).withColumnRenamed("id", "build_id")
    stored = ids.filter("build_id % 4 = 0").select(
        F.col("build_id").cast("string").alias("thread_id"), F.lit(0).alias("seq"), F.lit("append").alias("op"), F.lit(0).alias("expected_version"),
        F.transform(F.sequence(F.lit(0), (F.col("build_id") % 5).cast("int")), lambda k: F.to_json(text_message("user", F.concat(F.lit("old"), k.cast("string"))))).alias("payloads"),
    )
    store.commit(stored)
    store.compact()
    new = ids.filter("build_id % 10 < 9").select("build_id", F.posexplode(F.sequence(F.lit(0), (F.col("build_id") % 2).cast("int"))).alias("pos", "k")).select(
        "build_id", F.col("pos").cast("long").alias("pos"), text_message("user", F.concat(F.lit("new"), F.col("k").cast("string"))).alias("message")
    )
    builder = Builder(50, FixedCounter(10)).add_block("system", Strict(), [text_message("system", "hi")]).add_block("history", DropHead(), [])
    done = sync_all(_Crossed(store, spark), builder, "history", new, ids)
    assert done.rounds == 3

    def sequential(i: int):
        held, version = ([f"old{k}" for k in range(i % 5 + 1)], 1) if i % 4 == 0 else ([], 0)
        fresh = [f"new{k}" for k in range(i % 2 + 1)] if i % 10 < 9 else []
        rounds, kind = 1, None
        for every in (3, 9):
            writes = fresh or len(held) > 4
            if not (writes and i % every == 0):
                break
            held, version, rounds = [*held, f"other{rounds}"], version + 1, rounds + 1
        both = [*held, *fresh]
        kept = both[-4:]
        if kept != both:
            held, version, kind = kept, version + 1, "save"
        elif fresh:
            held, version, kind = both, version + 1, "append"
        return (kind or "noop", rounds), ["hi", *kept], (version, held)

    wanted = {i: sequential(i) for i in range(count)}
    assert {r.build_id: (r.action, r.rounds) for r in done.outcomes.collect()} == {i: w[0] for i, w in wanted.items()}
    context = done.contexts.groupBy("build_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "message"))), lambda x: x["message"]["Content"][0]["text"]).alias("texts"))
    assert {r.build_id: r.texts for r in context.collect()} == {i: w[1] for i, w in wanted.items()}
    assert _all(store, spark, map(str, range(count))) == {str(i): w[2] for i, w in wanted.items() if w[2][0]}


def test_threads_that_never_win_and_failed_builds(spark, tmp_path):
    class Lost(_Crossed):
        def commit(self, ops):
            self._store.commit(ops.withColumn("payloads", F.array(F.to_json(text_message("user", F.lit("other"))))).withColumn("op", F.lit("append")))
            return self._store.commit(ops)

    store = CompactedHistoryStore(spark, str(tmp_path / "store"))
    ids = spark.createDataFrame([(1,), (2,)], "build_id long")
    new = spark.createDataFrame([(1, 0, message("user", "a"))], ROW)
    builder = Builder(100, FixedCounter(10)).add_block("system", Strict(), [text_message("system", "hi")]).add_block("history", DropHead(), [])
    done = sync_all(Lost(store, spark), builder, "history", new, ids, rounds=2)
    assert sorted((r.build_id, r.action, r.rounds, r.error_code) for r in done.outcomes.collect()) == [(1, "conflict", 2, "HISTORY_VERSION_CONFLICT"), (2, "noop", 1, None)]
    assert _texts(store.load("1")[0]) == ["other", "other"] and done.contexts.filter("build_id = 1").count() == 0
    tight = Builder(5, FixedCounter(10)).add_block("system", Strict(), [text_message("system", "hi")]).add_block("history", DropHead(), [])
    failed = sync_all(store, tight, "history", new, ids).outcomes.collect()
    assert {(r.build_id, r.action, r.error_code, r.error_block) for r in failed} == {(k, "error", "BUDGET_EXCEEDED", "system") for k in (1, 2)}
    assert sync_all(store, builder, "history", new, ids.limit(0)).outcomes.count() == 0


def test_codes_of_a_wrong_configuration(spark, tmp_path):
    store = CompactedHistoryStore(spark, str(tmp_path / "store"))
    builder = Builder(100, FixedCounter(10)).add_block("history", DropHead(), [])
    ids, new = spark.createDataFrame([(1,)], "build_id long"), spark.createDataFrame([], ROW)
    cases = [
        (lambda: sync_all(None, builder, "history", new, ids), "INVALID_THREAD_CONFIG"),
        (lambda: sync_all(store, None, "history", new, ids), "INVALID_THREAD_CONFIG"),
        (lambda: sync_all(store, builder, "", new, ids), "INVALID_THREAD_CONFIG"),
        (lambda: sync_all(store, builder, "missing", new, ids), "BLOCK_NOT_FOUND"),
        (lambda: build_context(spark, store, builder, "missing", "t", []), "BLOCK_NOT_FOUND"),
        (lambda: build_context(spark, store, builder, "history", "", []), "INVALID_THREAD_CONFIG"),
        (lambda: build_context(spark, None, builder, "history", "t", []), "INVALID_THREAD_CONFIG"),
        (lambda: sync(builder, "missing", new, new, ids.withColumn("version", F.lit(0))), "BLOCK_NOT_FOUND"),
    ]
    for call, code in cases:
        with pytest.raises(ContextError) as error:
            call()
        assert error.value.code == code


def test_the_first_of_two_history_blocks_counts(spark):
    versions, none = spark.createDataFrame([(1, 0)], "build_id long, version long"), spark.createDataFrame([], ROW)
    new = spark.createDataFrame([(1, 0, message("user", "a"))], ROW)
    extra = spark.createDataFrame([(1, 0, message("user", "b"))], ROW)
    builder = Builder(100, FixedCounter(10)).add_block("history", DropHead(), []).add_block("history", DropHead(), extra)
    made = sync(builder, "history", none, new, versions)
    assert [(r.action, _texts(r.messages)) for r in made.writes.collect()] == [("append", ["a"])]
    assert made.built.messages.count() == 2
