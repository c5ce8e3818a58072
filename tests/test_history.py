"""Histories, thread sync, equality and streaming."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_assembly import frame, message
from tokenfold.errors import Cancelled, ContextError, classify
from tokenfold.functions.counters import FixedCounter
from tokenfold.functions.messages import MESSAGE, canonical_json, from_payload, image_part, messages_equal, multipart_message, text_message
from tokenfold.operators.builder import Builder
from tokenfold.operators.strategies import Drop, DropHead, Strict
from tokenfold.operators.thread import build_context, sync
from tokenfold.sources.history import OPS, FileHistoryStore, ResilientStore, replay, sync_thread
from tokenfold.streaming.replay import replay_stream


def replayed(spark, rows, **options):
    done = replay(spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], OPS), **options).first()
    return done.version, list(done.messages), [o.accepted for o in done.outcomes]


def test_replay(spark):
    assert replayed(spark, [("append", 0, ["one", "two"]), ("append", 1, ["three"])]) == (2, ["one", "two", "three"], [True, True])
    assert replayed(spark, [("append", 0, ["a"]), ("append", 0, ["b"])]) == (1, ["a"], [True, False])
    assert replayed(spark, [("append", 9, [])]) == (0, [], [True])
    saved = [("append", 0, ["a"]), ("save", 1, ["new"]), ("save", 2, [])]
    assert replayed(spark, saved) == (3, [], [True] * 3)
    assert replayed(spark, saved, flavour="reset") == (0, [], [True] * 3)
    assert replayed(spark, [("clear", 0, [])]) == (1, [], [True])
    assert replayed(spark, [("clear", 0, [])], flavour="reset") == (0, [], [True])


def test_ttl(spark):
    rows = [("t", 0, "append", 0, ["a"], 0), ("t", 1, "append", 1, ["b"], 50), ("t", 2, "append", 0, ["c"], 500)]
    ops = spark.createDataFrame(rows, "thread_id string, seq long, op string, expected_version long, payloads array<string>, at long")
    ops = ops.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    assert list(replay(ops, ttl_seconds=100).first().messages) == ["c"]
    assert list(replay(ops).first().messages) == ["a", "b"]


def test_file_store(spark, tmp_path):
    store = FileHistoryStore(spark, str(tmp_path / "store"))
    assert store.load("t") == ([], 0)
    texts = [message("user", t) for t in ("one", "two", "three")]
    store.append("t", 0, texts[:2])
    store.append("t", 1, texts[2:])
    store.append("u", 0, texts[:1])
    rows, version = store.load("t")
    assert ([r.Content[0].text for r in rows], version) == (["one", "two", "three"], 2)
    with pytest.raises(ContextError) as error:
        store.append("t", 1, texts[:1])
    assert error.value.code == "HISTORY_VERSION_CONFLICT"
    store.clear("t", 2)
    assert store.load("t") == ([], 3)
    assert len(store.load("u")[0]) == 1


def test_payload_that_is_no_message(spark):
    with pytest.raises(Exception, match="decode"):
        spark.createDataFrame([("1",)], "p string").select(from_payload(F.col("p"))).collect()


def test_resilient_store():
    class Flaky:
        left = 3

        def load(self, thread_id):
            self.left -= 1
            if self.left >= 0:
                raise TimeoutError("slow")
            return [], 7

    waits = []
    assert ResilientStore(Flaky(), waits.append).load("t") == ([], 7)
    assert waits == [0.01, 0.02, 0.04]
    dead = Flaky()
    dead.left = 99
    with pytest.raises(ContextError) as error:
        ResilientStore(dead, waits.append).load("t")
    assert error.value.code == "UNAVAILABLE"


def test_classify():
    assert classify(None) is None
    assert classify(ConnectionError()).code == "UNAVAILABLE"
    conflict, gone, plain = ContextError("HISTORY_VERSION_CONFLICT"), Cancelled(), ValueError()
    assert [classify(e) for e in (conflict, gone, plain)] == [conflict, gone, plain]


def test_sync_thread_tries_again():
    class Store:
        tries = 0

        def load(self, thread_id):
            return ["old"], self.tries

        def append(self, thread_id, version, messages):
            self.tries += 1
            if self.tries < 2:
                raise ContextError("HISTORY_VERSION_CONFLICT")

    store = Store()
    assert sync_thread(store, "t", lambda stored: (stored + ["new"], "append", ["new"])) == ["old", "new"]
    assert store.tries == 2
    with pytest.raises(ContextError):
        sync_thread(None, "t", None)


def synced(spark, limit, stored, new, first=Strict(), opening=("hi",), history=DropHead()):
    versions = spark.createDataFrame([(0, 4)], "build_id long, version long")
    builder = Builder(limit, FixedCounter(10)).add_block("system", first, [text_message("system", t) for t in opening]).add_block("history", history, [])
    empty = frame(spark)
    old = frame(spark, [message("user", t) for t in stored]) if stored else empty
    later = frame(spark, [message("user", t) for t in new]) if new else empty
    write = sync(builder, "history", old, later, versions).writes.first()
    return write.action, write.expected_version, [m.Content[0].text for m in write.messages or []]


def test_sync(spark):
    assert synced(spark, 100, ["old"], ["new"]) == ("append", 4, ["new"])
    assert synced(spark, 20, ["a", "b"], ["latest"]) == ("save", 4, ["latest"])
    assert synced(spark, 10, ["old"], ["new"], history=Drop()) == ("save_empty", 4, [])
    assert synced(spark, 100, ["old"], []) == ("noop", 4, [])
    assert synced(spark, 100, [], []) == ("noop", 4, [])
    assert synced(spark, 5, ["old"], ["new"])[0] == "error"


def test_equality(spark):
    a = text_message("user", "x", metadata=canonical_json({"a": [1]}))
    same = text_message("user", "x", name=None, metadata=canonical_json({"a": [1]}))
    other = text_message("user", "x", metadata=canonical_json({"a": [2]}))
    image, bare = multipart_message("user", F.array(image_part("u"))), multipart_message("user", F.array(image_part("v")))
    row = spark.range(1).select(messages_equal(a, same), messages_equal(a, other), messages_equal(image, image), messages_equal(image, bare)).first()
    assert list(row) == [True, False, True, False]


def test_no_update_is_lost_between_two_writers(spark, tmp_path):
    """A claims first and is slow: B's commit is judged only once A's is settled, by its coming or as void."""
    def one(text):
        return [message("user", text)]

    slow = FileHistoryStore(spark, str(tmp_path / "store"), patience=0.5)
    number = slow._claim()
    staged = str(tmp_path / "late")
    row = ("t", 0, "append", 0, [spark.createDataFrame([(one("late")[0],)], T.StructType([T.StructField("m", MESSAGE)])).select(F.to_json("m")).first()[0]])
    spark.createDataFrame([row], OPS).withColumn("ts", F.current_timestamp()).write.parquet(staged)
    assert slow.load("t") == ([], 0)
    slow.append("t", 0, one("quick"))
    with pytest.raises(ContextError) as error:
        slow._move(staged, number)
    assert error.value.code == "UNAVAILABLE"
    rows, version = slow.load("t")
    assert ([r.Content[0].text for r in rows], version) == (["quick"], 1)


def test_file_store_forgets_after_its_time_to_live(spark, tmp_path):
    store = FileHistoryStore(spark, str(tmp_path / "store"), ttl_seconds=3600)
    store.append("t", 0, [message("user", "a")])
    assert store.load("t")[1] == 1
    old = spark.createDataFrame([("u", 0, "append", 0, ["{}"])], OPS).withColumn("ts", F.current_timestamp() - F.expr("INTERVAL 2 HOURS"))
    store.commit(old)
    assert store.load("u") == ([], 0)


def test_build_context_on_a_store(spark, tmp_path):
    """Another writer comes between: the thread is loaded and built again, and nothing is lost."""
    inner = FileHistoryStore(spark, str(tmp_path / "store"))
    inner.append("t", 0, [message("user", "old")])

    class Crossed:
        tries = 0

        def load(self, thread_id):
            return inner.load(thread_id)

        def append(self, thread_id, version, messages):
            self.tries += 1
            if self.tries == 1:
                inner.append(thread_id, version, [message("user", "other")])
            inner.append(thread_id, version, messages)

    store = Crossed()
    builder = Builder(100, FixedCounter(10)).add_block("system", Strict(), [text_message("system", "hi")]).add_block("history", DropHead(), [])
    made = build_context(spark, store, builder, "history", "t", [message("user", "new")])
    assert [m.Content[0].text for m in made] == ["hi", "old", "other", "new"] and store.tries == 2
    assert [m.Content[0].text for m in inner.load("t")[0]] == ["old", "other", "new"]
    with pytest.raises(ContextError):
        build_context(spark, store, builder, "nowhere", "t", [])


def test_replay_stream(spark, tmp_path):
    rows = [("t", 0, "append", 0, ["a"]), ("t", 1, "append", 0, ["b"]), ("u", 2, "save", 0, ["c"]), ("t", 3, "clear", 1, [])]
    spark.createDataFrame(rows, OPS).write.parquet(str(tmp_path / "ops"))
    ops = spark.readStream.schema(OPS).parquet(str(tmp_path / "ops"))
    query = replay_stream(ops).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.thread_id, r.seq): (r.accepted, r.version, r.n_messages) for r in spark.table("outcomes").collect()}
    assert got == {("t", 0): (True, 1, 1), ("t", 1): (False, 1, 1), ("u", 2): (True, 1, 1), ("t", 3): (True, 2, 0)}
