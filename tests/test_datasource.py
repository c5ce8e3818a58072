"""The history data source against the store that it reads and writes."""

import os

import pytest
from pyspark.sql import functions as F

from tokenfold.sources.compacted import CompactedHistoryStore
from tokenfold.sources.datasource import FORMAT, HistoryDataSource, HistoryReader, HistoryWriter, Staged, bucket_of, thread_history

OPS = "thread_id string, seq long, op string, expected_version long, payloads array<string>"


def test_written_and_read_back(spark, tmp_path):
    root = str(tmp_path / "store")
    store = CompactedHistoryStore(spark, root, buckets=4)
    spark.dataSource.register(HistoryDataSource)
    assert spark.read.format(FORMAT).option("buckets", 4).load(root).count() == 0
    rows = [(f"t{k % 6}", k, "append", k // 6, [f"p{k}", f"q{k}"]) for k in range(12)] + [("t0", 99, "append", 0, ["stale"]), ("é", 5, "save", 0, ["x"]), ("gone", 6, "clear", 0, [])]
    spark.createDataFrame(rows, OPS).withColumn("ts", F.current_timestamp()).repartition(3).write.format(FORMAT).mode("append").save(root)
    assert store.compact() == 1
    wanted = {(r.thread_id, r.version, k, p) for r in _plain(spark, root).state().collect() for k, p in enumerate(r.messages)}
    whole = spark.read.format(FORMAT).option("buckets", 4).load(root)
    assert {tuple(r) for r in whole.collect()} == wanted and len(wanted) == 25
    assert whole.filter("thread_id = 't3' AND pos > 1").count() == 2 and whole.count() == 25
    one = thread_history(spark, root, ["t3", "é"], buckets=4)
    assert {tuple(r) for r in one.collect()} == {w for w in wanted if w[0] in ("t3", "é")}
    parts = HistoryReader(root, 4, {"t3", "é"}).partitions()
    assert {p.number for p in parts} == {bucket_of("t3", 4), bucket_of("é", 4)} and len(HistoryReader(root, 4, None).partitions()) > 1
    assert thread_history(spark, root, ["never"], buckets=4).count() == 0
    hashed = spark.createDataFrame([("t3",), ("é",), ("",)], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(4)).alias("b")).collect()
    assert all(bucket_of(r.t, 4) == r.b for r in hashed)


def _plain(spark, root):
    """The same folder as a store that replays its whole log."""
    from tokenfold.sources.history import FileHistoryStore

    return FileHistoryStore(spark, root)


def test_failed_attempts_and_aborts_leave_nothing(tmp_path):
    import pyarrow as pa

    root = str(tmp_path / "store")
    batch = pa.RecordBatch.from_pydict({"thread_id": ["t"], "seq": [0]})
    writer = HistoryWriter(root)
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.path != again.path
    writer.commit([again, None])
    assert os.listdir(f"{root}/log/commit=1") == [os.path.basename(again.path)]
    other = HistoryWriter(root)
    other.write(iter([batch]))
    other.abort([])
    assert os.listdir(f"{root}/staged") == [] and os.listdir(f"{root}/log") == ["commit=1"]
    late = HistoryWriter(root)
    os.close(os.open(f"{root}/claims/2", os.O_CREAT))
    late.commit([Staged("nothing")])
    assert sorted(os.listdir(f"{root}/log")) == ["commit=1", "commit=3"]


def test_overwriting_is_refused(spark, tmp_path):
    spark.dataSource.register(HistoryDataSource)
    rows = spark.createDataFrame([("t", 0, "append", 0, ["a"])], OPS).withColumn("ts", F.current_timestamp())
    with pytest.raises(Exception, match="appended"):
        rows.write.format(FORMAT).mode("overwrite").save(str(tmp_path / "store"))
