"""Token-budgeted assembly of many builds at once.

A build is one context under a hard budget; its blocks are served in order of registration. Each
message gets its weight and ``need`` by windows; the budget goes from block to block as sums over
rows of numbers. What stays is then a filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tokenfold.errors import ContextError
from tokenfold.functions.counters import ListCounter, TokenCounter, bad_count
from tokenfold.functions.messages import MESSAGE
from tokenfold.operators.formatter import DefaultFormatter
from tokenfold.operators.prefixes import longest_prefix
from tokenfold.operators.strategies import BLOCK, Custom, DropHead, DropTail, Strategy, Summarize
from tokenfold.sources.shared import written


@dataclass(frozen=True)
class Block:
    """A named block: messages keyed by build (build_id, pos, message), or the same literal ones for every build."""

    name: str
    strategy: Strategy | None
    messages: DataFrame | tuple[Column, ...]
    max_tokens: int = 0


@dataclass(frozen=True)
class BuildFrames:
    """Results of a batch of builds.

    ``messages``: build_id, ordinal, block_ord, block_name, pos, message, w of builds without error.
    ``blocks``: build_id, block_ord, block_name, tokens_in, budget, used, n_in, n_kept.
    ``kept``: the messages of each block after eviction, before the formatter.
    ``status``: build_id, error_code, error_block (null where fine), total_tokens, error_cause (what a counter or a strategy in Python said).
    """

    messages: DataFrame
    blocks: DataFrame
    kept: DataFrame
    status: DataFrame


@dataclass(frozen=True)
class Builder:
    """An immutable specification; every method returns another one."""

    max_tokens: int
    counter: TokenCounter | None
    blocks: tuple[Block, ...] = ()
    formatter: Callable[[DataFrame], DataFrame] = DefaultFormatter()

    def add_block(self, name: str, strategy: Strategy | None, messages: DataFrame | list[Column], max_tokens: int = 0) -> Builder:
        if not name:
            raise ValueError("a block needs a name")
        held = messages if isinstance(messages, DataFrame) else tuple(messages)
        return replace(self, blocks=(*self.blocks, Block(name, strategy, held, max_tokens)))

    def with_formatter(self, formatter: Callable[[DataFrame], DataFrame]) -> Builder:
        if formatter is None:
            raise ValueError("a formatter is needed")
        return replace(self, formatter=formatter)

    def with_block_messages(self, name: str, messages: DataFrame | list[Column]) -> Builder:
        """The first block of that name with other messages."""
        names = [b.name for b in self.blocks]
        if name not in names:
            raise ContextError("BLOCK_NOT_FOUND", name)
        at = names.index(name)
        held = messages if isinstance(messages, DataFrame) else tuple(messages)
        changed = replace(self.blocks[at], messages=held)
        return replace(self, blocks=(*self.blocks[:at], changed, *self.blocks[at + 1 :]))

    def clone(self) -> Builder:
        return self

    def build(self, keys: DataFrame) -> BuildFrames:
        """Build for every distinct ``build_id`` of ``keys``; failed builds are rows of ``status``."""
        if self.max_tokens <= 0 or self.counter is None:
            raise ContextError("INVALID_CONFIG")
        counter, cause = self.counter, None
        try:
            counter.weight(F.lit(None).cast(MESSAGE))
        except ContextError as error:
            # A counter that can't count at all fails every build, as one that fails on a message does.
            counter, cause = _NoCounter(), str(error)
        ids = keys.select("build_id").distinct()
        state = ids.select("build_id", F.lit(self.max_tokens).cast("long").alias("remaining"), *_no_error())
        kept, figures = [], []
        whole_lists = hasattr(counter, "count")
        stages = [[entry] for entry in enumerate(self.blocks)] if whole_lists else _stages(self.blocks)
        for group in stages:
            # Written once: what follows reads the columns it needs, and the messages only where they are returned.
            rows = _weighed(group, ids, counter)
            if whole_lists:
                out, made, state = _listed_stage(group[0], written(_needs(group, rows), "weighed"), state, counter)
            elif isinstance(group[0][1].strategy, Custom):
                out, made, state = _custom_stage(group[0], written(rows, "weighed"), state, counter)
            else:
                out, made, state = _native_stage(group, written(_needs(group, rows), "weighed"), state, counter)
            kept.append(out)
            figures.append(made)
        if not kept:
            empty = ids.sparkSession.createDataFrame([], T.StructType([ids.schema["build_id"], *_KEPT]))
            kept, figures = [empty], []
        # A stage's fold leaves nothing of a build that failed by then; what failed later, or in Python, goes here.
        alive = _union(kept)
        if len(stages) > 1 or any(isinstance(g[0][1].strategy, Custom) for g in stages):
            alive = alive.join(state.filter("error_code IS NULL").select("build_id"), "build_id", "left_semi")
        formatted = self.formatter(alive)
        counted = formatted.withColumn("w", counter.weight(F.col("message")))
        if whole_lists:
            totals = _list_totals(state, counted, counter)
        else:
            totals = counted.groupBy("build_id").agg(F.sum("w").alias("total"), F.max(bad_count(F.col("w"))).alias("bad"))
        total = F.coalesce("total", F.lit(0)).cast("long")
        fine = F.col("error_code").isNull()
        bad = F.coalesce("bad", F.lit(False)) | F.lit(cause is not None)
        status = state.join(totals, "build_id", "left").select(
            "build_id",
            F.when(fine & bad, "TOKEN_COUNT_FAILED")
            .when(fine & (total > self.max_tokens), "FORMATTER_EXCEEDED_BUDGET")
            .otherwise(F.col("error_code"))
            .alias("error_code"),
            "error_block",
            F.when(fine & bad, F.lit(0).cast("long")).otherwise(total).alias("total_tokens"),
            F.when((fine & bad) | (F.col("error_code") == "TOKEN_COUNT_FAILED"), F.lit(cause)).otherwise(F.col("error_cause")).alias("error_cause"),
        )
        if whole_lists:
            within = totals.filter((F.col("total") <= self.max_tokens) & ~F.col("bad")).select("build_id")
            return BuildFrames(counted.join(within, "build_id", "left_semi"), _union(figures) if figures else None, alive, status)
        build = Window.partitionBy("build_id")
        checked = counted.withColumns({"_total": F.sum("w").over(build), "_bad": F.max(bad_count(F.col("w"))).over(build)})
        messages = checked.filter((F.col("_total") <= self.max_tokens) & ~F.col("_bad")).drop("_total", "_bad")
        return BuildFrames(messages, _union(figures) if figures else None, alive, status)

    def build_or_raise(self, keys: DataFrame) -> BuildFrames:
        """``build``, raising the first failed build's error."""
        made = self.build(keys)
        failed = made.status.filter("error_code IS NOT NULL").orderBy("build_id").first()
        if failed:
            said = f": {failed.error_cause}" if failed.error_cause else ""
            raise ContextError(failed.error_code, f"build {failed.build_id}{said}", failed.error_block)
        return made


_KEPT = [
    T.StructField("block_ord", T.IntegerType()), T.StructField("block_name", T.StringType()), T.StructField("pos", T.LongType()),
    T.StructField("message", MESSAGE), T.StructField("w", T.LongType()),
]


class _NoCounter:
    """No message has a weight."""

    def weight(self, message: Column) -> Column:
        return F.lit(None).cast("long")


def _no_error() -> list[Column]:
    return [F.lit(None).cast("string").alias(name) for name in ("error_code", "error_block", "error_cause")]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _stages(blocks: tuple[Block, ...]) -> list[list[tuple[int, Block]]]:
    """Runs of blocks that one fold can serve. A strategy in Python is a stage of its own, and so is a
    summarizer, which is called for overfull blocks only and so must know its budget."""
    out: list[list[tuple[int, Block]]] = []
    for k, block in enumerate(blocks):
        alone = isinstance(block.strategy, (Custom, Summarize))
        if not out or alone or isinstance(out[-1][0][1].strategy, (Custom, Summarize)):
            out.append([])
        out[-1].append((k, block))
    return out


def _weighed(group: list[tuple[int, Block]], ids: DataFrame, counter: TokenCounter) -> DataFrame:
    """All messages of some blocks with their weights."""
    frames = []
    for k, block in group:
        if isinstance(block.messages, DataFrame):
            rows = block.messages.select("build_id", F.col("pos").cast("long").alias("pos"), "message")
        elif block.messages:
            rows = ids.select("build_id", F.posexplode(F.array(*block.messages)).alias("pos", "message")).withColumn("pos", F.col("pos").cast("long"))
        else:
            rows = ids.select("build_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(MESSAGE).alias("message")).filter(F.lit(False))
        frames.append(rows.select("build_id", F.lit(k).alias("block_ord"), F.lit(block.name).alias("block_name"), "pos", "message"))
    return _union(frames).withColumn("w", counter.weight(F.col("message")))


def _needs(group: list[tuple[int, Block]], rows: DataFrame) -> DataFrame:
    """``rows`` with total and need. Strategies whose need is a window over the block share one shuffle; the others have a plan each."""
    whole = Window.partitionBy(*BLOCK)
    summed = rows.withColumn("role", F.col("message.Role")).withColumn("total", F.sum("w").over(whole))
    by_strategy: dict[Strategy | None, list[int]] = {}
    for k, block in group:
        by_strategy.setdefault(block.strategy, []).append(k)
    parts = []
    shared, need = [], F.lit(0).cast("long")
    for strategy, at in by_strategy.items():
        own = F.lit(0) if strategy is None else strategy.need()
        if own is None:
            parts.append(strategy.with_need(summed.filter(F.col("block_ord").isin(*at)) if len(by_strategy) > 1 else summed))
        else:
            shared += at
            need = F.when(F.col("block_ord").isin(*at), own.cast("long")).otherwise(need)
    if shared:
        parts.append((summed.filter(F.col("block_ord").isin(*shared)) if parts else summed).withColumn("need", need))
    return _union(parts).drop("role")


def _native_stage(group, rows: DataFrame, state: DataFrame, counter: TokenCounter) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks whose need is known: the budget goes from block to block as a chain of sums, one a block, of rows of numbers.

    A build is never one row: what stays of a block is summed where ``need <= budget``, so a block of any size takes bounded memory.
    """
    summarizer = group[0][1].strategy if isinstance(group[0][1].strategy, Summarize) else None
    at, summaries = state, None
    if summarizer is not None:
        summaries = written(_summaries(group[0], rows, state, counter), "summaries")
        at = at.join(summaries.select("build_id", F.col("summary").isNotNull().alias("shortened"), "summary_w"), "build_id", "left")
    for k, block in group:
        at = _serve(at, rows, k, block)
    results = F.filter(F.array(*[f"r{k}" for k, _ in group]), lambda r: r.isNotNull())
    folded = written(at.select(*state.columns, results.alias("done")), "served")
    names = F.element_at(F.create_map(*[F.lit(x) for k, b in group for x in (k, b.name)]), F.col("block_ord"))
    figures = folded.select("build_id", F.inline("done")).select("build_id", "block_ord", names.alias("block_name"), "tokens_in", "budget", "used", "n_in", "n_kept")
    fine = folded.filter("error_code IS NULL").select("build_id", F.inline("done")).select(*BLOCK, "budget", "mode", "used")
    kept = rows.join(fine.select(*BLOCK, "budget", "mode"), BLOCK).filter(
        (F.col("mode") == "all") | ((F.col("mode") == "trim") & (F.col("need") <= F.col("budget")))
    )
    kept = kept.select("build_id", "block_ord", "block_name", "pos", "message", "w")
    if summaries is not None:
        short = fine.filter("mode = 'summary'").join(summaries, "build_id")
        kept = kept.unionByName(
            short.select(*BLOCK, F.lit(group[0][1].name).alias("block_name"), F.lit(0).cast("long").alias("pos"), F.col("summary").alias("message"), F.col("used").alias("w"))
        )
    return kept, figures, folded.drop("done")


def limit_of(block: Block) -> Column:
    """A block's budget: what remains, or its own cap if that is less."""
    return F.least(F.col("remaining"), F.lit(block.max_tokens).cast("long")) if block.max_tokens > 0 else F.col("remaining")


def in_order() -> Column:
    """A group's messages as an array, in their order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"])


def _summaries(entry: tuple[int, Block], rows: DataFrame, state: DataFrame, counter: TokenCounter) -> DataFrame:
    """The summary of every overfull block; the summarizer sees no other."""
    block = entry[1]
    due = state.filter("error_code IS NULL").select("build_id", limit_of(block).alias("limit"))
    lists = rows.join(due, "build_id").groupBy("build_id").agg(
        F.max("total").alias("total"), F.max("limit").alias("limit"), F.max(bad_count(F.col("w"))).alias("bad"), in_order().alias("list")
    )
    made = lists.filter("NOT bad AND total > limit").select("build_id", block.strategy.summarizer(F.col("list")).cast(MESSAGE).alias("summary"))
    return made.withColumn("summary_w", F.when(F.col("summary").isNotNull(), counter.weight(F.col("summary"))))


def _serve(state: DataFrame, rows: DataFrame, k: int, block: Block) -> DataFrame:
    """``state`` after one more block, with what the block got as ``r<k>`` (null if it has no messages or comes after an error)."""
    own = rows.filter(F.col("block_ord") == k).select("build_id", "w", "total", "need", F.lit(True).alias("here"))
    held = state.withColumn("budget", limit_of(block))
    # All of the state's columns depend on the build: as keys they stay where the join put them.
    stays = F.col("need") <= F.col("budget")
    sums = held.join(own, "build_id", "left").groupBy(*held.columns).agg(
        F.count("here").alias("n_in"),
        F.max("total").alias("tokens_in"),
        F.coalesce(F.max(F.col("here") & bad_count(F.col("w"))), F.lit(False)).alias("bad"),
        F.count(F.when(stays, 1)).alias("n_stay"),
        F.coalesce(F.sum(F.when(stays, F.col("w"))), F.lit(0)).cast("long").alias("w_stay"),
    )
    bare, strategy, zero = block.strategy is None, block.strategy, F.lit(0).cast("long")
    served = F.col("error_code").isNull() & (F.col("n_in") > 0)
    short = F.lit(False)
    if "shortened" in state.columns:
        bad_summary = F.coalesce(F.col("shortened"), F.lit(False)) & bad_count(F.col("summary_w"))
        sums = sums.withColumn("bad", F.col("bad") | bad_summary)
        short = F.coalesce(F.col("shortened") & (F.col("summary_w") <= F.col("budget")), F.lit(False))
    enough = (F.col("n_stay") > 0) & (F.col("n_stay") >= (0 if bare else strategy.min_messages))
    judged = sums.withColumn(
        "mode",
        F.when(~served | F.lit(bare) | F.col("bad"), "none")
        .when(F.col("tokens_in") <= F.col("budget"), "all")
        .when(short, "summary")
        .when(enough, "trim")
        .otherwise("none"),
    )
    mode = F.col("mode")
    used = F.when(mode == "all", F.col("tokens_in")).when(mode == "trim", F.col("w_stay"))
    n_kept = F.when(mode == "all", F.col("n_in")).when(mode == "trim", F.col("n_stay")).when(mode == "summary", F.lit(1).cast("long"))
    if "shortened" in state.columns:
        used = used.when(mode == "summary", F.col("summary_w"))
    on_empty = F.lit("NIL_STRATEGY" if bare else strategy.on_empty).cast("string")
    failure = on_empty if bare else F.when(F.col("bad"), "TOKEN_COUNT_FAILED").otherwise(on_empty)
    failed = served & (mode == "none") & failure.isNotNull()
    spent = judged.withColumns({"used": used.otherwise(zero).cast("long"), "n_kept": n_kept.otherwise(zero).cast("long")})
    result = F.struct(F.lit(k).alias("block_ord"), "tokens_in", "budget", "used", "n_in", "n_kept", "mode")
    return spent.select(
        "build_id",
        (F.col("remaining") - F.col("used")).cast("long").alias("remaining"),
        F.when(failed, failure).otherwise(F.col("error_code")).alias("error_code"),
        F.when(failed, F.lit(block.name)).otherwise(F.col("error_block")).alias("error_block"),
        "error_cause",
        *[c for c in state.columns if c.startswith("r") and c[1:].isdigit()],
        F.when(served, result).alias(f"r{k}"),
    )


def _custom_stage(entry: tuple[int, Block], rows: DataFrame, state: DataFrame, counter: TokenCounter) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A block whose strategy is Python: only overfull groups leave the JVM."""
    k, block = entry
    cap = block.max_tokens
    limit = F.least(F.col("remaining"), F.lit(cap)) if cap > 0 else F.col("remaining")
    sums = rows.groupBy("build_id").agg(F.sum("w").alias("tokens_in"), F.count("*").alias("n_in"), F.max(bad_count(F.col("w"))).alias("bad_in"))
    plan = state.join(sums, "build_id").withColumn("budget", limit).filter("error_code IS NULL")
    joined = rows.join(plan.filter("NOT bad_in").select("build_id", "tokens_in", "budget"), "build_id")
    fitting = joined.filter("tokens_in <= budget").select(*rows.columns, *[F.lit(None).cast("string").alias(n) for n in ("failure", "said")])
    trimmed = _applied(block.strategy, joined.filter("tokens_in > budget"))
    weight = F.when(F.col("failure").isNull(), counter.weight(F.col("message"))).alias("w")
    again = trimmed.select("build_id", F.lit(k).alias("block_ord"), F.lit(block.name).alias("block_name"), "pos", "message", weight, "failure", "said")
    out = fitting.unionByName(again)
    used = out.groupBy("build_id").agg(
        F.sum("w").alias("used"), F.count("*").alias("n_kept"), F.max("failure").alias("failure"), F.max("said").alias("said"),
        F.max(F.col("failure").isNull() & bad_count(F.col("w"))).alias("bad_out"),
    )
    done = plan.join(used, "build_id", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    code = (
        F.when(F.col("bad_in"), "TOKEN_COUNT_FAILED")
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("bad_out"), "TOKEN_COUNT_FAILED")
        .when(F.col("used") > F.col("budget"), "STRATEGY_EXCEEDED_BUDGET")
    )
    judged = done.withColumn("code", code)
    figures = judged.select(
        "build_id", F.lit(k).alias("block_ord"), F.lit(block.name).alias("block_name"), "tokens_in", "budget",
        F.when(F.col("code").isNull(), F.col("used")).otherwise(F.lit(0).cast("long")).alias("used"), "n_in",
        F.when(F.col("code").isNull(), F.coalesce("n_kept", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_kept"),
    )
    after = state.join(judged.select("build_id", "used", "code", "said"), "build_id", "left").select(
        "build_id",
        (F.col("remaining") - F.when(F.col("code").isNull(), F.coalesce("used", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))).alias("remaining"),
        F.coalesce("error_code", "code").alias("error_code"),
        F.when(F.col("error_code").isNull() & F.col("code").isNotNull(), block.name).otherwise(F.col("error_block")).alias("error_block"),
        F.coalesce("error_cause", F.when(F.col("error_code").isNull(), F.col("said"))).alias("error_cause"),
    )
    after = written(after, "served")
    return out.filter("failure IS NULL").drop("failure", "said"), figures, after


def _applied(strategy: Custom, overfull: DataFrame) -> DataFrame:
    """What a strategy in Python makes of overfull blocks: build_id, pos, message, failure, said."""
    apply = strategy.apply

    def trim(key, frame):
        """The strategy's messages; if it raises, one row with the failure's code, type and text."""
        import pandas as pd

        ordered = frame.sort_values("pos")
        try:
            out = apply(ordered[["pos", "message", "w"]], int(ordered["tokens_in"].iloc[0]), int(ordered["budget"].iloc[0]))
            out = out[["pos", "message"]].assign(failure=None, said=None)
        except Exception as error:
            code = error.code if isinstance(error, ContextError) else "STRATEGY_FAILED"
            out = pd.DataFrame({"pos": [0], "message": [None], "failure": [code], "said": [f"{type(error).__name__}: {error}"]})
        out.insert(0, "build_id", key[0])
        return out

    schema = T.StructType(
        [overfull.schema["build_id"], T.StructField("pos", T.LongType()), T.StructField("message", MESSAGE), T.StructField("failure", T.StringType()), T.StructField("said", T.StringType())]
    )
    return overfull.groupBy("build_id").applyInPandas(trim, schema)


def _list_totals(state: DataFrame, counted: DataFrame, counter: ListCounter) -> DataFrame:
    """(build_id, total, bad) of the final messages, counted as one list a build; a build without any has the count of an empty list."""
    order = ["ordinal"] if "ordinal" in counted.columns else ["block_ord", "pos"]
    lists = counted.groupBy("build_id").agg(F.array_sort(F.collect_list(F.struct(*order, "message"))).alias("rows"))
    fine = state.filter("error_code IS NULL").select("build_id").join(lists, "build_id", "left")
    messages = F.coalesce(F.transform("rows", lambda x: x["message"]), F.array().cast(T.ArrayType(MESSAGE)))
    totals = fine.select("build_id", messages.alias("list")).withColumn("total", counter.count(F.col("list")))
    return written(totals.select("build_id", F.col("total").cast("long").alias("total"), bad_count(F.col("total")).alias("bad")), "totals")


def _listed_stage(entry: tuple[int, Block], rows: DataFrame, state: DataFrame, counter: ListCounter) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A block under a counter of whole lists. A block's messages are one array where it is counted, as the counter takes them so."""
    k, block = entry
    strategy = block.strategy
    due = state.filter("error_code IS NULL").select("build_id", limit_of(block).alias("budget"))
    lists = rows.groupBy("build_id").agg(F.count("*").alias("n_in"), F.max(bad_count(F.col("w"))).alias("bad_w"), in_order().alias("list"))
    if strategy is None:
        sized = lists.withColumn("tokens_in", F.lit(0).cast("long"))
    else:
        sized = lists.withColumn("tokens_in", counter.count(F.col("list")).cast("long"))
    sized = written(due.join(sized, "build_id").drop("list"), "sized")
    over = sized.filter("tokens_in > budget" if strategy is not None else "false")
    overfull = rows.join(over.filter("NOT bad_w" if isinstance(strategy, DropHead) else "true").select("build_id", "tokens_in", "budget"), "build_id")
    none = F.lit(None).cast("string")
    if isinstance(strategy, Custom):
        trimmed = _applied(strategy, overfull)
    elif isinstance(strategy, Summarize):
        made = overfull.groupBy("build_id").agg(F.max("budget").alias("budget"), in_order().alias("list"))
        made = written(made.select("build_id", "budget", strategy.summarizer(F.col("list")).cast(MESSAGE).alias("message")).filter("message IS NOT NULL"), "summaries")
        sure = made.withColumn("got", counter.count(F.array("message")))
        failure = F.when(bad_count(F.col("got")), "TOKEN_COUNT_FAILED")
        short = sure.select("build_id", F.lit(0).cast("long").alias("pos"), "message", failure.alias("failure"), none.alias("said"), "got", "budget")
        trimmed = short.filter("failure IS NOT NULL OR got <= budget").drop("got", "budget")
    elif isinstance(strategy, DropTail):
        longest = over.agg(F.max("n_in")).first()[0] or 0
        whole = overfull.groupBy("build_id").agg(F.max("budget").alias("budget"), in_order().alias("list"))
        found = longest_prefix(whole, counter, longest)
        place = F.row_number().over(Window.partitionBy("build_id").orderBy("pos", "message"))
        failure = F.when(F.col("failed"), "TOKEN_COUNT_FAILED")
        numbered = overfull.withColumn("place", place).join(found, "build_id")
        trimmed = numbered.filter("failed OR place <= n_stay").select("build_id", "pos", "message", failure.alias("failure"), none.alias("said"))
    else:
        trimmed = overfull.filter("need <= budget").select("build_id", "pos", "message", none.alias("failure"), none.alias("said"))
    trimmed = written(trimmed, "trimmed")
    left = trimmed.groupBy("build_id").agg(F.count("*").alias("n_left"), F.max("failure").alias("failure"), F.max("said").alias("said"), in_order().alias("list"))
    least = max(1, strategy.min_messages) if strategy is not None else 1
    left = left.withColumn("got", F.when(F.col("failure").isNull(), counter.count(F.col("list"))).cast("long")).drop("list")
    fits, stays = F.col("tokens_in") <= F.col("budget"), F.coalesce("n_left", F.lit(0)) >= least
    code = (
        F.when(F.lit(strategy is None), "NIL_STRATEGY")
        .when(bad_count(F.col("tokens_in")), "TOKEN_COUNT_FAILED")
        .when(fits, none)
        .when(F.col("bad_w") & F.lit(isinstance(strategy, DropHead)), "TOKEN_COUNT_FAILED")
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(~stays, F.lit(None if strategy is None else strategy.on_empty).cast("string"))
        .when(bad_count(F.col("got")), "TOKEN_COUNT_FAILED")
        .when(F.col("got") > F.col("budget"), "STRATEGY_EXCEEDED_BUDGET")
    )
    zero = F.lit(0).cast("long")
    judged = sized.join(left, "build_id", "left").withColumns({"code": code, "fits": fits, "trims": ~fits & stays})
    fine = F.col("code").isNull()
    judged = written(
        judged.select(
            "build_id", "tokens_in", "budget", "n_in", "code", "said", "fits", "trims",
            F.when(fine & F.col("fits"), F.col("tokens_in")).when(fine & F.col("trims"), F.col("got")).otherwise(zero).alias("used"),
            F.when(fine & F.col("fits"), F.col("n_in")).when(fine & F.col("trims"), F.col("n_left")).otherwise(zero).alias("n_kept"),
        ), "judged",
    )
    named = [F.lit(k).alias("block_ord"), F.lit(block.name).alias("block_name")]
    going = judged.filter("code IS NULL")
    out = rows.join(going.filter("fits").select("build_id"), "build_id", "left_semi").select("build_id", *named, "pos", "message", "w").unionByName(
        trimmed.join(going.filter("trims").select("build_id"), "build_id", "left_semi").select("build_id", *named, "pos", "message", counter.weight(F.col("message")).alias("w"))
    )
    figures = judged.select("build_id", *named, "tokens_in", "budget", "used", "n_in", "n_kept")
    after = state.join(judged.select("build_id", "used", "code", "said"), "build_id", "left").select(
        "build_id",
        (F.col("remaining") - F.coalesce("used", zero)).alias("remaining"),
        F.coalesce("error_code", "code").alias("error_code"),
        F.when(F.col("error_code").isNull() & F.col("code").isNotNull(), block.name).otherwise(F.col("error_block")).alias("error_block"),
        F.coalesce("error_cause", F.when(F.col("error_code").isNull(), F.col("said"))).alias("error_cause"),
    )
    return out, figures, written(after, "served")
