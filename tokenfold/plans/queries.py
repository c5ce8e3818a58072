"""Registered queries: each operator over whole driver tables, with flat columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenfold.functions.counters import CharCounter, FixedCounter, TurnCounter
from tokenfold.functions.codecs import BASE64, JSON, unpack
from tokenfold.functions.messages import (
    all_text,
    canonical_json,
    first_text,
    from_payload,
    histories_equal,
    image_part,
    messages_equal,
    multipart_message,
    text_message,
    text_part,
    to_payload,
    tool_call,
    truncated,
)
from tokenfold.operators.builder import Builder, BuildFrames
from tokenfold.operators.formatter import DefaultFormatter, with_layers
from tokenfold.operators.strategies import Custom, Drop, DropHead, DropTail, Strict, Summarize, wrapped
from tokenfold.operators.thread import sync, sync_all, write_ops
from tokenfold.sources import chains
from tokenfold.sources.compacted import CompactedHistoryStore
from tokenfold.sources.shared import shared_dir

LIMIT = 300
CHARS = CharCounter(4)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: build_id, pos, message."""
    rows = _table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("build_id"), F.col("turn").alias("pos"), text_message(F.col("role"), F.col("text")).alias("message"))


def _tool_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations in which every fourth turn calls a tool and the next one is its result."""
    rows = _table(spark, sf_dir, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    calls, result = turn % 4 == 2, turn % 4 == 3
    role = F.when(calls, "assistant").when(result, "tool").otherwise(F.col("role"))
    call = tool_call(F.concat(F.lit("c"), turn.cast("string")), F.lit("search"), F.concat(F.lit('{"q":'), turn.cast("string"), F.lit("}")))
    made = multipart_message(
        role,
        F.array(text_part(F.col("text"))),
        tool_calls=F.when(calls, F.array(call)),
        tool_call_id=F.when(result & (conv % 3 != 0), F.concat(F.lit("c"), (turn - 1).cast("string"))).otherwise(F.lit("")),
    )
    return rows.select(conv.alias("build_id"), turn.alias("pos"), made.alias("message"))


def _build(talk: DataFrame, strategy, limit: int = LIMIT) -> BuildFrames:
    return Builder(limit, CHARS).add_block("talk", strategy, talk).build(talk)


def _kept(made: BuildFrames) -> DataFrame:
    return made.messages.select("build_id", "pos", "w")


def _status(made: BuildFrames) -> DataFrame:
    return made.status.select("build_id", F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("error_block", F.lit("")).alias("error_block"), "total_tokens")


def q01_char_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk(spark, sf_dir).select("build_id", "pos", CHARS.weight(F.col("message")).alias("w"))


def q02_fixed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = FixedCounter(10, 2, 5).weight(F.col("message"))
    return _tool_talk(spark, sf_dir).groupBy("build_id").agg(F.sum(weight).alias("total"), F.count("*").alias("n"))


def q03_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(_build(_talk(spark, sf_dir), Strict(), 700))


def q04_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_build(_talk(spark, sf_dir), Drop(), 700))


def q05_drop_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _build(_talk(spark, sf_dir), DropTail())
    counts = made.messages.groupBy("build_id").agg(F.count("*").alias("n_kept"))
    return _status(made).join(counts, "build_id", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0).cast("long")))


def q06_drop_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_build(_talk(spark, sf_dir), DropHead()))


def q07_drop_head_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_build(_talk(spark, sf_dir), DropHead(min_messages=2)))


def q08_drop_head_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_build(_talk(spark, sf_dir), DropHead(protected=("system",))))


def q09_drop_head_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_build(_tool_talk(spark, sf_dir), DropHead(atomic_turns=True)))


def q10_drop_head_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_build(_tool_talk(spark, sf_dir), DropHead(atomic_turns=True, min_messages=2, protected=("system", "tool"))))


def _short(messages: Column) -> Column:
    text = F.concat(F.lit("Summary of "), F.size(messages).cast("string"), F.lit(": "), truncated(first_text(F.get(messages, F.lit(0))), 80))
    return text_message(F.lit("system"), text)


def q11_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _build(_talk(spark, sf_dir), Summarize(_short))
    return made.messages.select("build_id", "pos", "w", all_text(F.col("message")).alias("text"))


def _assembly(spark: SparkSession, sf_dir: str, profile: str = "Profile: ") -> tuple[Builder, DataFrame]:
    """Instructions, reference items, a profile and the conversation under one budget."""
    talk = _talk(spark, sf_dir)
    keys = talk.select("build_id").distinct()
    items = _table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") % 10).alias("shelf"), F.col("item_id").alias("pos"), text_message("system", F.col("text")).alias("message")
    )
    reference = keys.withColumn("shelf", F.col("build_id") % 10).join(items, "shelf").select("build_id", "pos", "message")
    about = talk.filter("pos = 0").select("build_id", "pos", text_message("system", F.concat(F.lit(profile), first_text(F.col("message")))).alias("message"))
    builder = (
        Builder(500, CHARS)
        .add_block("instructions", Strict(), [text_message("system", "You are a helpful assistant.")])
        .add_block("reference", DropTail(), reference, max_tokens=200)
        .add_block("profile", Drop(), about, max_tokens=60)
        .add_block("conversation", DropHead(), talk)
    )
    return builder, keys


def q12_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    builder, keys = _assembly(spark, sf_dir)
    return builder.build(keys).messages.select("build_id", "block_name", "pos", "w")


def q13_block_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    builder, keys = _assembly(spark, sf_dir)
    return builder.build(keys).blocks.select("build_id", "block_name", "tokens_in", "budget", "used", "n_in", "n_kept")


def q14_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    builder, keys = _assembly(spark, sf_dir)
    return builder.build(keys).messages.select("build_id", "ordinal", "block_name", "pos")


def _doubled(inner):
    return lambda kept: inner(kept.unionByName(kept.withColumn("pos", F.col("pos") + 1000)))


def q15_formatter_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    builder, keys = _assembly(spark, sf_dir)
    return _status(builder.with_formatter(with_layers(DefaultFormatter(), _doubled)).build(keys))


def _synced(spark: SparkSession, sf_dir: str):
    talk = _talk(spark, sf_dir)
    last = talk.groupBy("build_id").agg(F.max("pos").alias("last"))
    marked = talk.join(last, "build_id")
    stored = marked.filter("pos < last").select("build_id", "pos", "message")
    new = marked.filter("pos = last AND build_id % 5 <> 0").select("build_id", F.lit(0).cast("long").alias("pos"), "message")
    versions = last.select("build_id", (F.col("build_id") % 7).alias("version"))
    builder = Builder(400, CHARS).add_block("instructions", Strict(), [text_message("system", "Be brief.")]).add_block("history", DropHead(), [])
    return sync(builder, "history", stored, new, versions)


def q16_thread_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = _synced(spark, sf_dir).writes
    return writes.select("build_id", "action", "expected_version", F.coalesce(F.size("messages"), F.lit(0)).cast("long").alias("n_messages"))


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as conditional writes: some versions are stale, so some writes conflict."""
    events = _table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    rank = F.row_number().over(order) - 1
    kind = F.col("event_id") % 11
    op = F.when(kind == 0, "clear").when(kind <= 3, "save").otherwise("append")
    payload = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    payloads = F.when((op == "clear") | (kind == 3) | (kind == 10), F.array().cast("array<string>")).otherwise(F.array(payload))
    stale = F.col("event_id") % 5 == 0
    return events.select(
        F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").alias("seq"), op.alias("op"),
        F.when(stale, F.lit(0)).otherwise(rank % 9).cast("long").alias("expected_version"), payloads.alias("payloads"), F.col("ts"),
    )


def _replayed(spark: SparkSession, sf_dir: str, flavour: str, ttl_seconds: int = 0) -> DataFrame:
    return chains.heads(chains.outcomes(_ops(spark, sf_dir), flavour, ttl_seconds))


def q17_replay_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "monotonic")


def q18_replay_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "reset")


def q19_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against a copy that is changed for some."""
    rows = _table(spark, sf_dir, "conversations")
    odd = (F.col("conv_id") % 3 == 0) & (F.col("turn") == 1)
    a = text_message(F.col("role"), F.col("text"), metadata=canonical_json({"k": [1, 2]}))
    b = text_message(F.col("role"), F.when(odd, F.concat("text", F.lit("!"))).otherwise(F.col("text")), name=None, metadata=canonical_json({"k": [1, 2]}))
    both = rows.select(F.col("conv_id").alias("build_id"), "turn", a.alias("a"), b.alias("b"))

    def listed(name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("turn", name))), lambda x: x[name])

    return both.groupBy("build_id").agg(
        F.sum(messages_equal(F.col("a"), F.col("b")).cast("long")).alias("n_equal"), histories_equal(listed("a"), listed("b")).alias("same")
    )


def q20_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _tool_talk(spark, sf_dir).select("build_id", "pos", to_payload(F.col("message")).alias("payload"))
    back = talk.select("build_id", "pos", from_payload(F.col("payload")).alias("message"))
    return back.select(
        "build_id", "pos", F.col("message.Role").alias("role"), all_text(F.col("message")).alias("text"),
        F.coalesce(F.get("message.ToolCalls", F.lit(0))["id"], F.lit("")).alias("call_id"), F.col("message.ToolCallID").alias("result_of"),
    )


def q21_tool_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _tool_talk(spark, sf_dir)
    estimated = CharCounter(4, estimator=lambda c: F.char_length(c["function"]["arguments"]).cast("long"))
    return talk.select("build_id", "pos", CHARS.weight(F.col("message")).alias("counted"), estimated.weight(F.col("message")).alias("estimated"))


def q22_image_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    parts = F.when(F.col("turn") % 2 == 0, F.array(text_part(F.col("text")), image_part(F.concat(F.lit("http://x/"), F.col("conv_id").cast("string"))))).otherwise(
        F.array(text_part(F.col("text")))
    )
    message = multipart_message(F.col("role"), parts)
    return rows.select(F.col("conv_id").alias("build_id"), F.col("turn").alias("pos"), CHARS.weight(message).alias("w"))


def q23_error_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict, bare and drop-tail blocks over one budget: the first failing block names the error."""
    talk = _talk(spark, sf_dir)
    bare = talk.filter("build_id % 4 = 1")
    builder = (
        Builder(450, CHARS)
        .add_block("opening", Strict(), talk.filter("pos <= 1"), max_tokens=250)
        .add_block("bare", None, bare.filter("pos = 2"))
        .add_block("rest", DropTail(), talk.filter("pos >= 2"))
    )
    return _status(builder.build(talk))


def q24_history_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories written as payloads, loaded in order with their version."""
    ops = write_ops(_synced(spark, sf_dir).writes.withColumn("expected_version", F.lit(0).cast("long")))
    rows = chains.loaded(chains.outcomes(ops))
    return rows.select("thread_id", "version", "pos", first_text(F.col("message")).alias("text"))


def q25_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "monotonic", 86_400)


def q26_other_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    builder, keys = _assembly(spark, sf_dir)
    changed = builder.with_block_messages("profile", [text_message("system", "No profile is known.")])
    return changed.build(keys).messages.select("build_id", "block_name", "pos", "w")


def q27_middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formatter layer that counts what it gets, around one that drops system messages."""

    def without_system(inner):
        return lambda kept: inner(kept.filter(F.col("message.Role") != "system"))

    def counted(inner):
        size = Window.partitionBy("build_id")
        return lambda kept: inner(kept.withColumn("n_before", F.count("*").over(size)))

    talk = _talk(spark, sf_dir)
    builder = Builder(LIMIT, CHARS, formatter=with_layers(DefaultFormatter(), counted, without_system)).add_block("talk", DropHead(), talk)
    rows = builder.build(talk).messages
    return rows.groupBy("build_id").agg(F.max("n_before").alias("n_before"), F.count("*").alias("n_after"), F.sum("w").alias("tokens"))


def q28_replay_hot_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all operations are one thread's, half of which are accepted."""
    ops = _ops(spark, sf_dir)
    hot = F.col("seq") % 3 == 0
    expected = F.when(hot, F.floor(F.col("seq") / 6).cast("long")).otherwise(F.col("expected_version"))
    return chains.heads(chains.outcomes(ops.withColumns({"thread_id": F.when(hot, "hot").otherwise(F.col("thread_id")), "expected_version": expected})))


def q29_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's metadata against the same tree written otherwise, before and after a round trip as payloads of two codecs."""
    rows = _table(spark, sf_dir, "conversations")
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    one = F.concat(F.lit('{"k": '), turn, F.lit(', "t": [{"x": 1, "y": null}, "a b", '), conv, F.lit("]}"))
    other = F.concat(F.lit('{"t":[{"y":null,"x":1.0},"a b",'), conv, F.lit('],"k":'), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('"'), turn, F.lit('"'))).otherwise(turn), F.lit("}"))
    made = rows.select(
        F.col("conv_id").alias("build_id"), "turn", text_message(F.col("role"), F.col("text"), metadata=one).alias("a"), text_message(F.col("role"), F.col("text"), metadata=other).alias("b")
    )
    packed = made.select("*", JSON.pack(F.col("a")).alias("json_a"), BASE64.pack(F.col("b")).alias("base64_b"))
    a, b = unpack(F.col("json_a")), unpack(F.col("base64_b"))
    return packed.select(
        "build_id", F.col("turn").alias("pos"), messages_equal(F.col("a"), F.col("b")).alias("equal"), messages_equal(a, b).alias("equal_after"),
        (messages_equal(a, F.col("a")) & messages_equal(b, F.col("b"))).alias("unchanged"), F.get_json_object("json_a", "$.Metadata.t[0].x").cast("long").alias("x"),
    )


def q30_counter_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter that can't count, and a strategy in Python that fails on some blocks: codes, blocks and causes."""

    def apply(rows, tokens, limit):
        if len(rows) % 2:
            raise ValueError("odd")
        return rows.tail(1)[["pos", "message"]]

    talk = _talk(spark, sf_dir)
    none = Builder(LIMIT, CharCounter(0)).add_block("talk", Drop(), talk.filter("build_id % 2 = 0")).build(talk).status
    own = Builder(LIMIT, FixedCounter(100)).add_block("own", Custom(apply), talk).build(talk).status
    both = none.withColumn("kind", F.lit("counter")).unionByName(own.withColumn("kind", F.lit("strategy")))
    cause = F.regexp_extract(F.coalesce("error_cause", F.lit("")), "(INVALID_CHARS_PER_TOKEN|ValueError: odd)", 1)
    return both.select("kind", "build_id", F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("error_block", F.lit("")).alias("error_block"), cause.alias("cause"), "total_tokens")


def _store(spark: SparkSession) -> CompactedHistoryStore:
    return CompactedHistoryStore(spark, f"{shared_dir(spark)}/tokenfold/store-{uuid.uuid4().hex}")


class _Rival:
    """A store in which, before the first commit counts, another writer appends to every third of its threads."""

    def __init__(self, store: CompactedHistoryStore):
        self._store, self._first = store, True

    def __getattr__(self, name: str):
        return getattr(self._store, name)

    def commit(self, ops: DataFrame) -> int:
        if self._first:
            other = F.array(to_payload(text_message("user", F.lit("other"))))
            self._store.commit(ops.filter("cast(thread_id AS bigint) % 3 = 0").withColumns({"op": F.lit("append"), "payloads": other}))
            self._first = False
        return self._store.commit(ops)


def q31_batch_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation synced with a store at once, its last turn being new; a third of the writes lose their first round."""
    talk = _talk(spark, sf_dir)
    marked = talk.join(talk.groupBy("build_id").agg(F.max("pos").alias("last")), "build_id")
    store = _store(spark)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", to_payload(F.col("message")).alias("payload")))), lambda x: x["payload"])
    old = marked.filter("pos < last").groupBy("build_id").agg(listed.alias("payloads"))
    store.commit(old.select(F.col("build_id").cast("string").alias("thread_id"), F.lit(0).alias("seq"), F.lit("append").alias("op"), F.lit(0).alias("expected_version"), "payloads"))
    store.compact()
    new = marked.filter("pos = last AND build_id % 5 <> 0").select("build_id", F.lit(0).cast("long").alias("pos"), "message")
    builder = Builder(400, CHARS).add_block("instructions", Strict(), [text_message("system", "Be brief.")]).add_block("history", DropHead(), [])
    ids = talk.select("build_id").distinct()
    done = sync_all(_Rival(store), builder, "history", new, ids).outcomes
    heads, rows = store.snapshot(ids.select(F.col("build_id").cast("string").alias("thread_id")))
    counts = rows.groupBy("thread_id").agg(F.count("*").alias("n_stored"))
    ends = heads.join(counts, "thread_id", "left").select(F.col("thread_id").cast("long").alias("build_id"), "version", F.coalesce("n_stored", F.lit(0)).cast("long").alias("n_stored"))
    return done.select("build_id", "action", "rounds").join(ends, "build_id")


def q32_compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations in three commits, two of them under a snapshot and their log expired: what the store holds of each thread."""
    ops, store = _ops(spark, sf_dir), _store(spark)
    for k in range(3):
        store.commit(ops.filter(F.pmod(F.floor(F.col("seq") / 1000), F.lit(3)) == k))
        if k == 1:
            store.compact()
            store.expire()
    stored = ops.select("thread_id").distinct()
    heads, rows = store.payloads(stored)
    counts = rows.groupBy("thread_id").agg(F.count("*").alias("n_messages"))
    return heads.join(counts, "thread_id", "left").select("thread_id", "version", F.coalesce("n_messages", F.lit(0)).cast("long").alias("n_messages"))


def q33_list_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop-tail under a counter of whole lists, whose changes of role cost tokens of their own."""
    talk = _talk(spark, sf_dir)
    return _kept(Builder(LIMIT, TurnCounter(CHARS, 4, 3)).add_block("talk", DropTail(), talk).build(talk))


def q34_list_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop-head goes by weights; where what it leaves has too many tokens as a list, the build fails."""
    talk = _talk(spark, sf_dir)
    made = Builder(LIMIT, TurnCounter(CHARS, 4, 3)).add_block("talk", DropHead(), talk).build(talk)
    return _status(made).join(made.blocks.select("build_id", "tokens_in", "used", "n_kept"), "build_id")


def q35_own_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strategy in Python that keeps every other message, inside a layer that goes on halving until what stays fits."""
    talk = _talk(spark, sf_dir)

    def every_other(rows, tokens, limit):
        return rows.iloc[::2]

    def until_it_fits(inner):
        def apply(rows, tokens, limit):
            while len(rows) and rows["w"].sum() > limit:
                rows = inner(rows, tokens, limit) if len(rows) > 1 else rows.iloc[:0]
            return rows

        return apply

    return _kept(_build(talk, wrapped(Custom(every_other), until_it_fits)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "q" and name[1:3].isdigit()}
