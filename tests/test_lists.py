"""Counters of whole lists, and blocks of any size, against plain loops."""

import random
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_assembly import frame, message
from tokenfold.functions.counters import FixedCounter, TurnCounter
from tokenfold.functions.messages import text_message
from tokenfold.operators.builder import Builder
from tokenfold.operators.strategies import Custom, Drop, DropHead, DropTail, Strict, Summarize

LIMIT = 60


class Joint:
    """Joint tokens: pairs of equal neighbours are cheaper, so a longer list can have fewer tokens."""

    grows = False

    def weight(self, message):
        return FixedCounter(10).weight(message)

    def count(self, messages):
        @F.pandas_udf("long")
        def joint(lists: pd.Series) -> pd.Series:
            roles = lists.map(lambda ms: [m["Role"] for m in ms])
            return roles.map(lambda rs: 10 * len(rs) - 12 * sum(a == b for a, b in zip(rs, rs[1:])) + 5)

        return joint(messages)


def joint_count(roles):
    return 10 * len(roles) - 12 * sum(a == b for a, b in zip(roles, roles[1:])) + 5


def turn_count(roles):
    return 7 * len(roles) + 4 * sum(a != b for a, b in zip(roles, roles[1:])) + (3 if roles else 0)


def plain_tail(roles, count, limit):
    """(kept, error) of one block by a loop over prefixes."""
    if count(roles) <= limit:
        return len(roles), None
    for n in range(len(roles) - 1, 0, -1):
        if count(roles[:n]) <= limit:
            return n, None
    return 0, "BLOCK_TOO_LARGE"


def plain_head(roles, count, weight, limit, least=0):
    if not roles or count(roles) <= limit:
        return len(roles), None
    n = min(len(roles), limit // weight)
    if n < max(1, least):
        return 0, None
    return (0, "STRATEGY_EXCEEDED_BUDGET") if count(roles[len(roles) - n :]) > limit else (n, None)


def talks(seed, builds=60):
    chance = random.Random(seed)
    return [[chance.choice(["user", "assistant"]) for _ in range(chance.randint(1, 17))] for _ in range(builds)]


@pytest.mark.parametrize(
    "counter,count,weight", [(TurnCounter(FixedCounter(7), 4, 3), turn_count, 7), (Joint(), joint_count, 10)], ids=["turns", "joint"]
)
@pytest.mark.parametrize("strategy", [DropTail(), DropHead(min_messages=2)], ids=["tail", "head"])
def test_against_a_plain_loop(spark, counter, count, weight, strategy):
    roles = talks(3)
    keys = spark.range(len(roles)).withColumnRenamed("id", "build_id")
    made = Builder(LIMIT, counter).add_block("b", strategy, frame(spark, *[[message(r, "x") for r in rs] for rs in roles])).build(keys)
    kept = {r.build_id: r.n for r in made.messages.groupBy("build_id").agg(F.count("*").alias("n")).collect()}
    status = {r.build_id: (r.error_code, r.total_tokens) for r in made.status.collect()}
    for b, rs in enumerate(roles):
        n, error = plain_tail(rs, count, LIMIT) if isinstance(strategy, DropTail) else plain_head(rs, count, weight, LIMIT, 2)
        left = rs[:n] if isinstance(strategy, DropTail) else rs[len(rs) - n :]
        assert (kept.get(b, 0), status[b]) == (n, (error, 0 if error else count(left))), rs


def test_budget_goes_from_list_to_list(spark):
    counter, keys = TurnCounter(FixedCounter(7), 4, 3), spark.createDataFrame([(0,)], "build_id long")
    a, b = text_message("user", "a"), text_message("assistant", "b")
    builder = (
        Builder(76, counter)
        .add_block("keep", Strict(), [a])
        .add_block("none", Strict(), [])
        .add_block("drop", Drop(), [a, b], max_tokens=20)
        .add_block("short", Summarize(lambda m: text_message("system", "s")), [a, b], max_tokens=10)
        .add_block("own", Custom(lambda rows, tokens, limit: rows.tail(1)), [a, b], max_tokens=10)
        .add_block("tail", DropTail(), [a, b, a, b])
    )
    made = builder.build(keys)
    figures = {r.block_name: (r.tokens_in, r.budget, r.used, r.n_kept) for r in made.blocks.collect()}
    assert figures == {"keep": (10, 76, 10, 1), "drop": (21, 20, 0, 0), "short": (21, 10, 10, 1), "own": (21, 10, 10, 1), "tail": (43, 46, 43, 4)}
    # One list a build at the end: seven messages, six changes of role, one start.
    assert made.status.first().total_tokens == 7 * 7 + 6 * 4 + 3
    assert [r.block_name for r in made.messages.orderBy("ordinal").collect()] == ["keep", "short", "own", "tail", "tail", "tail", "tail"]
    # The blocks fit one by one, with 73 tokens; joined they have 76.
    status = replace(builder, max_tokens=75).build(keys).status.first()
    assert (status.error_code, status.total_tokens) == ("FORMATTER_EXCEEDED_BUDGET", 76)


def test_failures(spark):
    keys = spark.createDataFrame([(0,)], "build_id long")
    a = text_message("user", "a")

    class Broken(TurnCounter):
        def count(self, messages):
            return F.lit(None).cast("long")

    def outcome(builder):
        row = builder.build(keys).status.first()
        return row.error_code, row.error_block

    turns = TurnCounter(FixedCounter(7), 4, 3)
    assert outcome(Builder(9, turns).add_block("b", Strict(), [a])) == ("BUDGET_EXCEEDED", "b")
    assert outcome(Builder(9, turns).add_block("b", DropTail(), [a])) == ("BLOCK_TOO_LARGE", "b")
    assert outcome(Builder(9, turns).add_block("b", None, [a])) == ("NIL_STRATEGY", "b")
    assert outcome(Builder(9, turns).add_block("b", Custom(lambda rows, tokens, limit: rows), [a])) == ("STRATEGY_EXCEEDED_BUDGET", "b")
    assert outcome(Builder(9, Broken(FixedCounter(7), 4, 3)).add_block("b", Strict(), [a])) == ("TOKEN_COUNT_FAILED", "b")
    assert outcome(Builder(9, turns).add_block("b", Strict(), [])) == (None, None)


def test_a_large_build_is_never_one_row(spark):
    n = 50_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("build_id"), F.col("id").alias("pos"), text_message("user", F.col("id").cast("string")).alias("message"))
    made = Builder(n, FixedCounter(3)).add_block("a", DropTail(), rows, max_tokens=n // 2).add_block("b", DropHead(), rows).build(rows.select("build_id").limit(1))
    assert [(r.used, r.n_kept) for r in made.blocks.orderBy("block_ord").collect()] == [(24_999, 8_333), (24_999, 8_333)]
    ends = made.messages.groupBy("block_name").agg(F.min("pos").alias("low"), F.max("pos").alias("high")).orderBy("block_name").collect()
    assert [(r.low, r.high) for r in ends] == [(0, 8_332), (n - 8_333, n - 1)]
