"""Thread sync: stored history and new messages to a context, and what to write back, for many threads."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.errors import ContextError
from tokenfold.functions.messages import MESSAGE, histories_equal, to_payload
from tokenfold.operators.builder import Builder, BuildFrames
from tokenfold.sources.history import MAX_SYNC_ROUNDS, sync_thread
from tokenfold.sources.shared import written


@dataclass(frozen=True)
class Sync:
    """``built`` is the contexts; ``writes`` has build_id, action, expected_version and messages.

    ``action``: append the new messages, save the shortened history, save_empty, noop, or error.
    """

    built: BuildFrames
    writes: DataFrame


def candidate_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """History and, after it, the new messages (both build_id, pos, message)."""
    last = history.groupBy("build_id").agg((F.max("pos") + 1).alias("offset"))
    later = new.join(last, "build_id", "left").select(
        "build_id", (F.col("pos") + F.coalesce("offset", F.lit(0))).cast("long").alias("pos"), "message"
    )
    return history.select("build_id", F.col("pos").cast("long").alias("pos"), "message").unionByName(later)


def sync(builder: Builder, history_block: str, history: DataFrame, new: DataFrame, versions: DataFrame) -> Sync:
    """One round for every thread of ``versions`` (build_id, version); a failed build writes nothing."""
    if not history_block:
        raise ContextError("INVALID_THREAD_CONFIG")
    names = [b.name for b in builder.blocks]
    candidate = candidate_history(history, new)
    built = builder.with_block_messages(history_block, candidate).build(versions)
    # Of several blocks of that name the first is the history.
    history_ord = names.index(history_block)

    def listed(rows: DataFrame, name: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"])
        return rows.groupBy("build_id").agg(ordered.alias(name))

    kept = listed(built.kept.filter(F.col("block_ord") == history_ord), "kept")
    state = (
        versions.join(built.status, "build_id")
        .join(listed(candidate, "all"), "build_id", "left")
        .join(kept, "build_id", "left")
        .join(listed(new, "new"), "build_id", "left")
    )
    action = (
        F.when(F.col("error_code").isNotNull(), "error")
        .when(histories_equal(F.col("all"), F.col("kept")), F.when(F.col("new").isNotNull(), "append").otherwise("noop"))
        .when(F.col("kept").isNull(), "save_empty")
        .otherwise("save")
    )
    chosen = state.withColumn("action", action)
    messages = F.when(F.col("action") == "append", F.col("new")).when(F.col("action") == "save", F.col("kept"))
    return Sync(built, chosen.select("build_id", "action", F.col("version").alias("expected_version"), messages.alias("messages")))


def write_ops(writes: DataFrame) -> DataFrame:
    """The writes as an op log: thread_id, seq, op, expected_version, payloads."""
    payloads = F.transform(F.coalesce("messages", F.array().cast(writes.schema["messages"].dataType)), to_payload)
    return writes.filter(F.col("action").isin("append", "save", "save_empty")).select(
        F.col("build_id").cast("string").alias("thread_id"),
        F.lit(0).cast("long").alias("seq"),
        F.when(F.col("action") == "append", "append").otherwise("save").alias("op"),
        "expected_version",
        payloads.alias("payloads"),
    )


@dataclass(frozen=True)
class Synced:
    """Results of ``sync_all``, written: ``contexts`` is build_id, ordinal, block_name, pos, message; ``outcomes`` is
    build_id, action (as of ``Sync``, or ``conflict`` if every round had one), rounds, error_code and error_block."""

    contexts: DataFrame
    outcomes: DataFrame
    rounds: int


def sync_all(store, builder: Builder, history_block: str, new: DataFrame, threads: DataFrame, rounds: int = MAX_SYNC_ROUNDS) -> Synced:
    """Load, build and write every thread of ``threads`` (build_id), each with its ``new`` messages (build_id, pos, message).

    A round is one load, one build and one commit of all threads at hand; those whose write met another
    version go into the next round, with what is stored then. After the last round they are left as
    ``conflict``, with nothing written. A build that fails writes nothing and isn't tried again. ``store`` has
    ``snapshot``, ``commit`` and ``accepted`` of frames; a thread's id there is its build_id as text.
    """
    if store is None or builder is None or not history_block:
        raise ContextError("INVALID_THREAD_CONFIG")
    if history_block not in [b.name for b in builder.blocks]:
        raise ContextError("BLOCK_NOT_FOUND", history_block)
    pending = written(threads.select("build_id", F.col("build_id").cast("string").alias("thread_id")).distinct(), "pending")
    contexts, outcomes, number = [], [], 0
    while number < rounds and not pending.isEmpty():
        number += 1
        heads, messages = store.snapshot(pending.select("thread_id"))
        versions = written(pending.join(heads, "thread_id", "left").select("build_id", F.coalesce("version", F.lit(0)).cast("long").alias("version")), "versions")
        history = written(pending.join(messages, "thread_id").select("build_id", "pos", "message"), "loaded")
        made = sync(builder, history_block, history, new.join(pending.select("build_id"), "build_id", "left_semi"), versions)
        writes = written(made.writes, "writes")
        built = written(made.built.messages.select("build_id", "ordinal", "block_name", "pos", "message"), "contexts")
        failures = written(made.built.status.select("build_id", "error_code", "error_block"), "status")
        ops = written(write_ops(writes), "ops")
        lost = pending.limit(0)
        if not ops.isEmpty():
            taken = store.accepted(store.commit(ops), pending.select("thread_id"))
            lost = written(pending.join(taken.filter("NOT accepted").select("thread_id"), "thread_id", "left_semi"), "pending")
        last = number == rounds
        settled = writes.join(failures, "build_id").join(lost.select("build_id", F.lit(True).alias("lost")), "build_id", "left")
        action = F.when(F.col("lost"), "conflict").otherwise(F.col("action"))
        code = F.when(F.col("lost"), "HISTORY_VERSION_CONFLICT").otherwise(F.col("error_code"))
        kept = settled if last else settled.filter("lost IS NULL")
        outcomes.append(kept.select("build_id", action.alias("action"), F.lit(number).alias("rounds"), code.alias("error_code"), "error_block"))
        contexts.append(built.join(lost.select("build_id"), "build_id", "left_anti"))
        pending = lost
    if not number:
        kind = threads.schema["build_id"]
        none = threads.sparkSession.createDataFrame
        shown = T.StructType([kind, T.StructField("ordinal", T.LongType()), T.StructField("block_name", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("message", MESSAGE)])
        told = T.StructType([kind, *(T.StructField(n, t) for n, t in (("action", T.StringType()), ("rounds", T.IntegerType()), ("error_code", T.StringType()), ("error_block", T.StringType())))])
        return Synced(none([], shown), none([], told), 0)
    return Synced(reduce(DataFrame.unionByName, contexts), reduce(DataFrame.unionByName, outcomes), number)


def build_context(spark: SparkSession, store, builder: Builder, history_block: str, thread_id: str, new: list) -> list:
    """One thread from end to end: load it from ``store``, build with the ``new`` messages, write what changed.

    A conflicting write of another writer makes it start again from what is stored then. Returns the
    context's messages; a build that fails raises its error and writes nothing.
    """
    if store is None or builder is None or not thread_id or not history_block:
        raise ContextError("INVALID_THREAD_CONFIG")
    if history_block not in [b.name for b in builder.blocks]:
        raise ContextError("BLOCK_NOT_FOUND", history_block)
    schema = T.StructType([T.StructField("build_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("message", MESSAGE)])
    later = spark.createDataFrame([(0, k, m) for k, m in enumerate(new)], schema)

    def build(stored: list) -> tuple[list, str, list]:
        old = spark.createDataFrame([(0, k, m) for k, m in enumerate(stored)], schema)
        done = sync(builder, history_block, old, later, spark.createDataFrame([(0, 0)], "build_id long, version long"))
        status, write = done.built.status.first(), done.writes.first()
        if status.error_code:
            raise ContextError(status.error_code, f"thread {thread_id}", status.error_block)
        context = [r.message for r in done.built.messages.orderBy("ordinal").select("message").collect()]
        return context, write.action, list(write.messages or [])

    return sync_thread(store, thread_id, build)
