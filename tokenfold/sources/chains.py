"""Replay of conditional operations for threads of any length.

An accepted write fixes the version that the thread has after it, so it also fixes which write is
accepted next: the first later one that expects that version. These links are looked up for all
operations at once. The accepted writes are the chain of links from the first write that expects
version 0; it is followed by pointer doubling, in as many rounds as the longest chain has binary
digits. No thread is ever one row: threads of up to ``FOLDED`` operations are folded in an array of
that size at most, longer ones go by their links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.functions.messages import from_payload
from tokenfold.operators.ordered import dealt, following, running
from tokenfold.sources.history import FLAVOURS
from tokenfold.sources.shared import written

#: Operations of a thread up to which it is folded as one array.
FOLDED = 1000

#: An operation that stands for what a thread was before the others: the version is the expected one plus one, whatever came before.
RESTORE = "restore"

#: Columns of an operation's outcome.
OUTCOMES = ["thread_id", "place", "seq", "op", "payloads", "accepted", "version", "fresh", "empty", "size"]

#: The order of a thread's operations; those of one ``seq`` go by what they are.
ORDER = ["seq", "op", "expected_version", "payloads", "ts"]


def _prepared(ops: DataFrame) -> DataFrame:
    """Operations with ``ts``, the number of payloads, whether they write, and whether they leave nothing."""
    ts = F.col("ts").cast("timestamp") if "ts" in ops.columns else F.lit(None).cast("timestamp")
    rows = ops.select("thread_id", F.col("seq").cast("long").alias("seq"), "op", F.col("expected_version").cast("long").alias("expected_version"), F.when(F.col("op") != "clear", F.col("payloads")).alias("payloads"), ts.alias("ts"))
    rows = rows.withColumn("payloads", F.coalesce("payloads", F.array().cast("array<string>")))
    size = F.size("payloads")
    return rows.withColumns({"writes": (F.col("op") != "append") | (size > 0), "empties": (F.col("op") == "clear") | ((F.col("op") == "save") & (size == 0))})


def _after(flavour: str) -> Column:
    """The version after an operation, if it is accepted."""
    bumped = F.col("expected_version") + 1
    return F.when(F.col("empties"), F.lit(0).cast("long")).otherwise(bumped) if flavour == "reset" else bumped


def _links(rows: DataFrame, ttl_seconds: int) -> DataFrame:
    """(place, next) of the dealt writes: which write is accepted after each, if it is accepted itself.

    Before its time to live is over that is the next one that expects ``after``, from then on the next
    that expects version 0.
    """
    group = ["thread_id", "version"]
    asks = rows.select("thread_id", F.col("after").alias("version"), (2 * F.col("place") + 1).alias("at"), F.lit(True).alias("asks"), "place", "clock")
    gives = rows.select("thread_id", F.col("expected_version").alias("version"), (2 * F.col("place")).alias("at"), F.lit(False).alias("asks"), "place", "clock")
    target = F.when(~F.col("asks"), F.struct("place", "clock"))
    # Against the order an asking row comes before its own giving row, and so doesn't find itself.
    next_same = following(asks.unionByName(gives), group, ["at"], F.col("asks"), target, ["place", "clock"])
    if ttl_seconds <= 0:
        return next_same.filter("found IS NOT NULL").select("place", F.col("found.place").alias("next"))
    until = F.col("clock") + ttl_seconds * 1_000_000
    late = rows.select("thread_id", until.alias("clock"), F.lit(0).alias("kind"), "place", F.lit(True).alias("asks"))
    zero = rows.filter("expected_version = 0").select("thread_id", "clock", F.lit(1).alias("kind"), "place", F.lit(False).alias("asks"))
    order = ["clock", "kind", "place"]
    fresh = following(late.unionByName(zero).withColumn("own", F.col("place")), ["thread_id"], order, F.col("asks"), F.when(~F.col("asks"), F.col("own")), ["own"])
    both = next_same.join(fresh.select(F.col("own").alias("place"), F.col("found").alias("later")), "place")
    in_time = F.col("found.clock") < until
    return both.select("place", F.when(in_time, F.col("found.place")).otherwise(F.col("later")).alias("next")).filter("next IS NOT NULL")


def _chain(links: DataFrame, starts: DataFrame) -> DataFrame:
    """The places on the chains of ``links`` (place, next) from ``starts`` (place), by pointer doubling."""
    reached, jumps = written(starts, "reached"), written(links, "jumps")
    # Links lead forward, so that after each round they are twice as long and at last none is left.
    while not jumps.isEmpty():
        stepped = reached.join(jumps, "place").select(F.col("next").alias("place"))
        reached = written(reached.unionByName(stepped), "reached")
        further = jumps.select(F.col("place").alias("next"), F.col("next").alias("last"))
        jumps = written(jumps.join(further, "next").select("place", F.col("last").alias("next")), "jumps")
    return reached


def _by_links(ops: DataFrame, flavour: str, ttl_seconds: int) -> DataFrame:
    rows = dealt(ops, ["thread_id"], ORDER)
    time = F.unix_micros("ts") if ttl_seconds > 0 else F.lit(0).cast("long")
    # Time doesn't go back: an operation stamped earlier than one before it counts as simultaneous.
    rows = running(rows, ["thread_id"], "clock", "max", time) if ttl_seconds > 0 else rows.withColumn("clock", time)
    rows = written(rows.withColumn("after", _after(flavour)), "clocked")
    writes = rows.filter("writes")
    starts = writes.filter((F.col("expected_version") == 0) | (F.col("op") == RESTORE)).groupBy("thread_id").agg(F.min("place").alias("place")).select("place")
    chain = _chain(_links(writes, ttl_seconds), starts)
    judged = rows.join(chain.withColumn("chosen", F.lit(True)), "place", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    # A row to carry on needs its place; the join keeps it, and a part's share of a thread is as before.
    state = F.when(F.col("chosen"), F.struct("after", "clock"))
    judged = written(running(judged, ["thread_id"], "last", "last", state, inclusive=False), "judged")
    gone = F.lit(False) if ttl_seconds <= 0 else F.col("clock") >= F.col("last.clock") + ttl_seconds * 1_000_000
    expired = F.col("last").isNull() | gone
    held = F.when(expired, F.lit(0).cast("long")).otherwise(F.col("last.after"))
    told = judged.select(
        "part", "thread_id", "place", "seq", "op", "payloads", (~F.col("writes") | F.col("chosen")).alias("accepted"),
        F.when(F.col("chosen"), F.col("after")).otherwise(held).alias("version"),
        (F.col("chosen") & ((F.col("op") != "append") | expired)).alias("fresh"), (~F.col("chosen") & expired).alias("empty"),
    )
    # The messages held are those written so far, less those before the history began anew.
    own = F.when(F.col("accepted"), F.size("payloads")).otherwise(0).cast("long")
    summed = running(told, ["thread_id"], "upto", "sum", own)
    dated = running(summed, ["thread_id"], "before", "last", F.when(F.col("fresh"), F.col("upto") - F.size("payloads")))
    size = F.when(F.col("empty"), F.lit(0).cast("long")).otherwise(F.col("upto") - F.col("before"))
    return dated.withColumn("size", size).select(*OUTCOMES)


def _folded(ops: DataFrame, flavour: str, ttl_seconds: int) -> DataFrame:
    """The same of threads of up to ``FOLDED`` operations, by one pass over an array of each."""
    op = F.struct(*ORDER, "writes", "empties")
    gathered = ops.groupBy("thread_id").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    outcome = "array<struct<accepted:boolean,version:bigint,fresh:boolean,empty:boolean,size:bigint>>"
    start = F.struct(
        F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("alive"), F.lit(None).cast("long").alias("written"),
        F.lit(None).cast("long").alias("clock"), F.array().cast(outcome).alias("outcomes"),
    )

    def step(at: Column, op: Column) -> Column:
        clock = F.greatest(at["clock"], F.unix_micros(op["ts"])) if ttl_seconds > 0 else F.lit(None).cast("long")
        gone = F.coalesce(clock >= at["written"] + ttl_seconds * 1_000_000, F.lit(False)) if ttl_seconds > 0 else F.lit(False)
        version = F.when(gone, F.lit(0).cast("long")).otherwise(at["version"])
        alive = at["alive"] & ~gone
        chosen = op["writes"] & ((op["op"] == RESTORE) | (op["expected_version"] == version))
        bumped = op["expected_version"] + 1
        after = F.when(op["empties"], F.lit(0).cast("long")).otherwise(bumped) if flavour == "reset" else bumped
        now = F.when(chosen, after).otherwise(version)
        fresh = chosen & ((op["op"] != "append") | ~alive)
        came = F.size(op["payloads"]).cast("long")
        size = F.when(fresh, came).when(~chosen & ~alive, F.lit(0).cast("long")).when(chosen, at["size"] + came).otherwise(at["size"])
        done = F.struct((~op["writes"] | chosen).alias("accepted"), now.alias("version"), fresh.alias("fresh"), (~chosen & ~alive).alias("empty"), size.alias("size"))
        return F.struct(
            now.alias("version"), size.alias("size"), (chosen | alive).alias("alive"), F.when(chosen, clock).when(gone, F.lit(None).cast("long")).otherwise(at["written"]).alias("written"),
            clock.alias("clock"), F.concat(at["outcomes"], F.array(done)).alias("outcomes"),
        )

    folded = gathered.select("thread_id", "ops", F.aggregate("ops", start, step, lambda at: at["outcomes"]).alias("outcomes"))
    zipped = folded.select("thread_id", F.posexplode(F.arrays_zip("ops", "outcomes")).alias("place", "x"))
    return zipped.select("thread_id", F.col("place").cast("long").alias("place"), "x.ops.seq", "x.ops.op", "x.ops.payloads", "x.outcomes.*").select(*OUTCOMES)


def outcomes(ops: DataFrame, flavour: str = "monotonic", ttl_seconds: int = 0, folded: int = FOLDED) -> DataFrame:
    """One row per operation: thread_id, place (rising with the thread's order), seq, op, payloads, accepted, the thread's version after it,
    ``fresh`` (it starts the history anew), ``empty`` (the thread has no history just then) and ``size``, its messages after it.

    Operations are as of ``history.replay``, in order of ``seq``. With ``ttl_seconds`` (0: never) a thread not written for that
    long by ``ts`` has expired; ``ts`` going back counts as standing still. Null payloads are none; repeated rows are operations
    of their own. A thread's first operation may be a ``RESTORE``. Which way a thread goes, by array or by links, changes nothing in the result.
    """
    if flavour not in FLAVOURS:
        raise ValueError(f"unknown flavour {flavour}")
    if ttl_seconds < 0:
        raise ValueError("the time to live may not be negative")
    rows = _prepared(ops)
    long = rows.groupBy("thread_id").count().filter(F.col("count") > folded).select("thread_id")
    if long.isEmpty():
        return _folded(rows, flavour, ttl_seconds)
    long = written(long, "long-threads")
    short = _folded(rows.join(long, "thread_id", "left_anti"), flavour, ttl_seconds)
    return short.unionByName(_by_links(rows.join(long, "thread_id", "left_semi"), flavour, ttl_seconds))


def heads(judged: DataFrame) -> DataFrame:
    """Per thread of ``outcomes``: version, n_messages, n_accepted, n_ops."""
    return judged.groupBy("thread_id").agg(
        F.max_by("version", "place").alias("version"), F.max_by("size", "place").alias("n_messages"), F.sum(F.col("accepted").cast("long")).alias("n_accepted"), F.count("*").alias("n_ops")
    )


def histories(judged: DataFrame) -> DataFrame:
    """The messages that threads hold after their last operation: thread_id, version, pos, payload.

    Rows of a thread are numbered by sums over its parts, so a history may be of any length.
    """
    last = judged.groupBy("thread_id").agg(
        F.max_by("version", "place").alias("last_version"), F.max_by("empty", "place").alias("gone"), F.max(F.when(F.col("fresh"), F.col("place"))).alias("start")
    )
    live = judged.join(last.filter("NOT gone"), "thread_id").filter("accepted AND place >= start AND size(payloads) > 0")
    rows = dealt(live.select("thread_id", F.col("place").alias("rank"), F.col("last_version").alias("version"), "payloads"), ["thread_id"], ["rank"])
    offset = running(rows, ["thread_id"], "offset", "sum", F.size("payloads").cast("long"), inclusive=False)
    each = offset.select("thread_id", "version", "offset", F.posexplode("payloads").alias("k", "payload"))
    return each.select("thread_id", "version", (F.col("offset") + F.col("k")).alias("pos"), "payload")


def loaded(judged: DataFrame) -> DataFrame:
    """``histories`` with messages: thread_id, version, pos, message."""
    return histories(judged).select("thread_id", "version", "pos", from_payload(F.col("payload")).alias("message"))
