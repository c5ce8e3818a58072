"""Metadata by value, payload codecs, and logs that hold several of them."""

import pytest
from pyspark.sql import functions as F

from tests.test_assembly import frame, message
from tests.test_stores import _texts
from tokenfold.errors import ContextError
from tokenfold.functions.codecs import BASE64, JSON, Codec, unpack
from tokenfold.functions.counters import CharCounter, FixedCounter
from tokenfold.functions.messages import canonical, from_payload, messages_equal, text_message, to_payload
from tokenfold.operators.builder import Builder
from tokenfold.operators.strategies import Custom, Drop, Strict
from tokenfold.sources.compacted import CompactedHistoryStore

PAIRS = [
    ('{"a": 1, "b": [1, {"c": null}]}', '{"b":[1.0,{"c":null}],"a":1}', True),
    ('{"a": 1}', '{"a": "1"}', False),
    ('{"a": [1, 2]}', '{"a": [2, 1]}', False),
    ('{"a": true}', '{"a": 1}', False),
    ('{"a": null}', "{}", False),
    ("{}", None, True),
    ("not json", "not json", True),
    ("not json", '"not json"', False),
    ('{"é": "\\u00e9"}', '{"\\u00e9":"é"}', True),
    ('{"a": 0.10}', '{"a":0.1}', True),
]


def test_metadata_are_equal_by_value_before_and_after_payloads(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(PAIRS)], "k int, a string, b string")
    a, b = (text_message("user", "x", metadata=F.col(c)) for c in "ab")
    back = [from_payload(to_payload(m)) for m in (a, b)]
    got = {r.k: (r.before, r.after, r.same) for r in rows.select("k", messages_equal(a, b).alias("before"), messages_equal(*back).alias("after"), messages_equal(a, back[0]).alias("same")).collect()}
    for k, (_, _, equal) in enumerate(PAIRS):
        assert got[k][0] is equal and got[k][2], PAIRS[k]
        # A string that is no JSON and the JSON string of it are one after a round trip.
        assert got[k][1] is (equal or k == 7), PAIRS[k]
    shown = rows.filter("k = 0").select(F.get_json_object(to_payload(a), "$.Metadata.b[1]").alias("part"), canonical(F.col("b")).alias("text")).first()
    assert (shown.part, shown.text) == ('{"c":null}', '{"a":1,"b":[1,{"c":null}]}')


def test_quoted_metadata_of_earlier_payloads_are_read(spark):
    rows = spark.createDataFrame([('{"Role":"user","Metadata":"{\\"z\\":1,\\"a\\":2}"}',), (None,)], "p string")
    got = [r.m for r in rows.select(from_payload(F.col("p")).alias("m")).collect()]
    assert got[0].Metadata == '{"a":2,"z":1}' and got[1] is None


def test_log_in_several_codecs_loads_whole(spark, tmp_path):
    root = str(tmp_path / "store")
    second = Codec("base64", 2, lambda m: F.reverse(F.base64(F.encode(to_payload(m), "UTF-8"))), lambda t: from_payload(F.decode(F.unbase64(F.reverse(t)), "UTF-8")))
    for version, codec in enumerate((JSON, BASE64, second)):
        CompactedHistoryStore(spark, root, codec=codec, readable=(BASE64, second)).append("t", version, [message("user", f"m{version} é~"), message("user", "~x.1:")])
    store = CompactedHistoryStore(spark, root, readable=(BASE64, second))
    store.compact()
    assert _texts(store.load("t")[0]) == ["m0 é~", "~x.1:", "m1 é~", "~x.1:", "m2 é~", "~x.1:"]
    tags = [p[0][:10] for p in store._held("rows", "thread_id string, pos long, payload string, bucket int").orderBy("pos").select("payload").collect()]
    assert tags[0].startswith("{") and tags[2] == "~base64.1:" and tags[4] == "~base64.2:"
    with pytest.raises(Exception, match="unknown codec: ~base64.2"):
        CompactedHistoryStore(spark, root).load("t")
    for name, number in (("a-b", 1), ("", 1), ("a", 0)):
        with pytest.raises(ValueError):
            Codec(name, number, to_payload, from_payload)


def test_null_payloads_stay_null(spark):
    rows = spark.createDataFrame([(None,)], "p string")
    assert rows.select(unpack(F.col("p")).alias("m")).first().m is None


def test_counter_that_cannot_count_is_a_status(spark):
    keys = spark.createDataFrame([(0,), (9,)], "build_id long")
    for per in (0, -1):
        builder = Builder(100, CharCounter(per)).add_block("a", Strict(), frame(spark, [message("user", "x")]))
        rows = {r.build_id: r for r in builder.build(keys).status.collect()}
        assert [(rows[k].error_code, rows[k].error_block) for k in (0, 9)] == [("TOKEN_COUNT_FAILED", "a"), ("TOKEN_COUNT_FAILED", None)]
        assert all("INVALID_CHARS_PER_TOKEN" in r.error_cause and r.total_tokens == 0 for r in rows.values())
        with pytest.raises(ContextError, match="INVALID_CHARS_PER_TOKEN"):
            builder.build_or_raise(keys)


def test_what_a_python_strategy_said_is_kept(spark):
    def fails(rows, tokens, limit):
        raise KeyError("no such thing")

    def too_large(rows, tokens, limit):
        raise ContextError("BLOCK_TOO_LARGE", "by far")

    keys, talk = spark.createDataFrame([(0,)], "build_id long"), frame(spark, [message("user", "x")] * 3)
    for apply, code, text in ((fails, "STRATEGY_FAILED", "KeyError: 'no such thing'"), (too_large, "BLOCK_TOO_LARGE", "by far")):
        builder = Builder(20, FixedCounter(10)).add_block("own", Custom(apply), talk).add_block("after", Drop(), talk)
        status = builder.build(keys).status.first()
        assert (status.error_code, status.error_block) == (code, "own") and text in status.error_cause
        with pytest.raises(ContextError, match=text.split(":")[0]):
            builder.build_or_raise(keys)
