"""Golden cases and a differential test of strategies and builder."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.model import drop_head
from tokenfold.errors import ContextError
from tokenfold.functions.counters import CharCounter, FixedCounter
from tokenfold.functions.messages import MESSAGE, multipart_message, text_message, text_part, tool_call, image_part
from tokenfold.operators.builder import Builder
from tokenfold.operators.strategies import Custom, Drop, DropHead, DropTail, Strict, Summarize, wrapped

ROWS = T.StructType([T.StructField("build_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("message", MESSAGE)])


def message(role, text="", calls=(), answer=""):
    made = [{"id": c, "type": "function", "function": {"name": "f", "arguments": "{}"}} for c in calls]
    return (role, [("text", text, None)], "", [(m["id"], m["type"], ("f", "{}")) for m in made], answer, None)


def frame(spark, *builds):
    rows = [(b, i, m) for b, messages in enumerate(builds) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, ROWS)


def kept_texts(made):
    rows = made.messages.orderBy("build_id", "ordinal").select("build_id", F.get("message.Content", F.lit(0))["text"].alias("t")).collect()
    return [r.t for r in rows]


def one(spark, strategy, texts, limit, per=10, **options):
    talk = frame(spark, [message("user", t) for t in texts])
    made = Builder(limit, FixedCounter(per)).add_block("b", strategy, talk, **options).build(spark.createDataFrame([(0,)], "build_id long"))
    return kept_texts(made), made.status.first()


def weights(spark, counter, *messages):
    return [r[0] for r in spark.range(1).select(F.explode(F.array(*[counter.weight(m) for m in messages]))).collect()]


def test_char_counter(spark):
    texts = ["", "abcd", "abcdefgh", "hello", "x", "привет", "🔥", "Hi 世界"]
    assert weights(spark, CharCounter(4), *[text_message("user", t) for t in texts]) == [0, 1, 2, 2, 1, 2, 1, 2]
    assert weights(spark, CharCounter(1), text_message("user", "hello")) == [5]
    call = multipart_message("assistant", F.array(text_part("ab")), tool_calls=F.array(tool_call("1", "foo", "{}")))
    assert weights(spark, CharCounter(4, estimator=lambda c: F.lit(10)), call) == [31]
    assert weights(spark, CharCounter(4), call) == [22]
    assert weights(spark, CharCounter(4), multipart_message("user", F.array(image_part("u")))) == [85]
    for bad in (0, -1):
        with pytest.raises(ContextError) as error:
            CharCounter(bad).weight(F.col("message"))
        assert error.value.code == "INVALID_CHARS_PER_TOKEN"
    assert weights(spark, FixedCounter(10), text_message("user", "anything"), text_message("user", "")) == [10, 10]


@pytest.mark.parametrize(
    "strategy,texts,limit,expected,error",
    [
        (Strict(), "ab", 20, "ab", None),
        (Strict(), "ab", 19, "", "BUDGET_EXCEEDED"),
        (Drop(), "ab", 20, "ab", None),
        (Drop(), "ab", 9, "", None),
        (DropTail(), "123", 30, "123", None),
        (DropTail(), "123", 20, "12", None),
        (DropTail(), "1", 5, "", "BLOCK_TOO_LARGE"),
        (DropTail(), "12", 10, "1", None),
        (DropHead(), "123", 15, "3", None),
        (DropHead(min_messages=2), "123", 15, "", None),
    ],
)
def test_strategies(spark, strategy, texts, limit, expected, error):
    kept, status = one(spark, strategy, texts, limit)
    assert "".join(kept) == expected
    assert status.error_code == error
    assert status.error_block == ("b" if error else None)


def test_summarize(spark):
    summary = Summarize(lambda messages: text_message("system", "summary"))
    assert one(spark, summary, "ab", 20)[0] == ["a", "b"]
    assert one(spark, summary, "ab", 15)[0] == ["summary"]
    assert one(spark, summary, "ab", 5)[0] == []
    with pytest.raises(ValueError):
        Summarize(None)


GOLDEN = [
    ("u a1 t t u", dict(atomic=True), 21, [4]),
    ("s u a", dict(atomic=True), 25, [1, 2]),
    ("s u a", dict(atomic=True), 15, [2]),
    ("d s u a u a", dict(protected=("d", "s")), 41, [0, 1, 4, 5]),
    ("d u a u", dict(protected=("d",)), 10, [0]),
    ("d s", dict(protected=("d", "s")), 10, []),
    ("d a1 t", dict(protected=("d",), atomic=True), 5, []),
    ("d u a", dict(protected=("d",), least=2), 10, []),
]
ROLES = {"s": "system", "u": "user", "a": "assistant", "t": "tool", "d": "developer"}


def test_drop_head_golden(spark):
    for text, options, limit, expected in GOLDEN:
        talk = [message(ROLES[x[0]], x, calls=[x] if len(x) > 1 else []) for x in text.split()]
        protected = tuple(ROLES[r] for r in options.get("protected", ()))
        strategy = DropHead(options.get("atomic", False), options.get("least", 0), protected)
        made = Builder(limit, FixedCounter(10)).add_block("b", strategy, frame(spark, talk)).build(spark.createDataFrame([(0,)], "build_id long"))
        assert sorted(r.pos for r in made.messages.collect()) == expected, text


@pytest.mark.parametrize("atomic", [False, True])
@pytest.mark.parametrize("protected,least", [((), 0), (("system",), 0), (("tool", "system"), 3), (("assistant",), 2)])
def test_drop_head_like_the_model(spark, atomic, protected, least):
    chance = random.Random(f"{atomic}{protected}{least}")
    builds = []
    for _ in range(150):
        talk = []
        for _ in range(chance.randint(1, 9)):
            role = chance.choice(["user", "assistant", "tool", "tool", "system"])
            calls = [chance.choice(["a", "b", "c", ""]) for _ in range(chance.randint(0, 2))] if role == "assistant" else []
            talk.append(message(role, "x" * chance.randint(0, 9), calls, chance.choice(["", "a", "b", "c"]) if role == "tool" else ""))
        builds.append(talk)
    counter, limit = CharCounter(1), 40
    made = Builder(limit, counter).add_block("b", DropHead(atomic, least, protected), frame(spark, *builds)).build(spark.range(150).withColumnRenamed("id", "build_id"))
    got = {}
    for r in made.messages.collect():
        got.setdefault(r.build_id, []).append(r.pos)
    for b, talk in enumerate(builds):
        w = [len(m[1][0][1]) + sum(3 + 20 for _ in m[3]) for m in talk]
        simple = [(m[0], [c[0] for c in m[3]], m[4]) for m in talk]
        assert sorted(got.get(b, [])) == drop_head(simple, w, limit, protected, atomic, least), (talk, w)


def test_mixed_build(spark):
    builder = (
        Builder(100, FixedCounter(10))
        .add_block("keep", Strict(), [text_message("system", "keep")])
        .add_block("drop", Drop(), [text_message("user", t) for t in ("d1", "d2")], max_tokens=10)
        .add_block("head", DropHead(), [text_message("user", t) for t in ("old", "new")], max_tokens=10)
        .add_block("summary", Summarize(lambda m: text_message("system", "summary")), [text_message("user", t) for t in "xy"], max_tokens=10)
        .add_block("tail", DropTail(), [text_message("user", f"tail-{i}") for i in (1, 2, 3)], max_tokens=20)
    )
    keys = spark.createDataFrame([(0,), (1,)], "build_id long")
    made = builder.build(keys)
    assert kept_texts(made) == ["keep", "new", "summary", "tail-1", "tail-2"] * 2
    assert {(r.error_code, r.total_tokens) for r in made.status.collect()} == {(None, 50)}
    assert kept_texts(builder.clone().build(keys)) == kept_texts(made)


def test_errors(spark):
    keys = spark.createDataFrame([(0,)], "build_id long")
    a = [text_message("user", "a")]
    for bad in (Builder(0, FixedCounter(1)), Builder(1, None)):
        with pytest.raises(ContextError) as error:
            bad.build(keys)
        assert error.value.code == "INVALID_CONFIG"
    with pytest.raises(ContextError) as error:
        Builder(10, FixedCounter(1)).with_block_messages("x", a)
    assert error.value.code == "BLOCK_NOT_FOUND"
    bare = Builder(10, FixedCounter(1)).add_block("first", None, []).add_block("bare", None, a)
    with pytest.raises(ContextError) as error:
        bare.build_or_raise(keys)
    assert (error.value.code, error.value.block) == ("NIL_STRATEGY", "bare")
    twice = Builder(10, FixedCounter(10), formatter=lambda kept: kept.unionByName(kept)).add_block("b", Strict(), a)
    assert twice.build(keys).status.first().error_code == "FORMATTER_EXCEEDED_BUDGET"
    assert twice.build(keys).messages.count() == 0
    with pytest.raises(ValueError):
        bare.with_formatter(None)


def test_custom_strategy(spark):
    keys = spark.createDataFrame([(0,)], "build_id long")
    three = [text_message("user", t) for t in "abc"]
    calls = []

    def last_one(rows, tokens, limit):
        return rows.tail(1)

    layered = wrapped(Custom(last_one), lambda inner: lambda rows, tokens, limit: inner(rows, tokens, limit))
    builder = Builder(30, FixedCounter(10)).add_block("own", layered, three, max_tokens=10).add_block("rest", DropHead(), three)
    assert kept_texts(builder.build(keys)) == ["c", "b", "c"]
    greedy = Builder(30, FixedCounter(10)).add_block("own", Custom(lambda rows, tokens, limit: rows.head(2)), three, max_tokens=10)
    status = greedy.build(keys).status.first()
    assert (status.error_code, status.error_block, status.total_tokens) == ("STRATEGY_EXCEEDED_BUDGET", "own", 0)
    assert greedy.build(keys).messages.count() == 0 and greedy.build(keys).kept.count() == 0
    assert not calls


def test_failures_are_rows_of_status(spark):
    keys = spark.createDataFrame([(0,), (1,)], "build_id long")
    two = [text_message("user", t) for t in "ab"]

    def failing(rows, tokens, limit):
        raise KeyError("no")

    def refusing(rows, tokens, limit):
        raise ContextError("BLOCK_TOO_LARGE")

    class Weights(FixedCounter):
        def weight(self, message):
            return F.when(message["Content"][0]["text"] == "b", F.lit(self.bad).cast("long")).otherwise(F.lit(5).cast("long"))

    def outcome(builder):
        made = builder.build(keys)
        assert made.messages.count() == 0
        return {(r.error_code, r.error_block, r.total_tokens) for r in made.status.collect()}

    assert outcome(Builder(10, FixedCounter(10)).add_block("own", Custom(failing), two)) == {("STRATEGY_FAILED", "own", 0)}
    assert outcome(Builder(10, FixedCounter(10)).add_block("own", Custom(refusing), two)) == {("BLOCK_TOO_LARGE", "own", 0)}
    for bad in (None, -5):
        counter = Weights(1)
        object.__setattr__(counter, "bad", bad)
        for strategy in (DropHead(), Strict(), Custom(failing)):
            assert outcome(Builder(100, counter).add_block("own", strategy, two)) == {("TOKEN_COUNT_FAILED", "own", 0)}
    with pytest.raises(ValueError):
        Builder(1, FixedCounter(1)).add_block("", Strict(), two)


def test_summarizer_is_called_for_overfull_blocks_only(spark):
    two = [text_message("user", t) for t in "ab"]
    only = Summarize(lambda m: F.when(F.size(m) > 0, F.raise_error(F.lit("called")).cast(MESSAGE)))
    made = Builder(20, FixedCounter(10)).add_block("s", only, two).build(spark.range(2).withColumnRenamed("id", "build_id"))
    assert kept_texts(made) == ["a", "b"] * 2
