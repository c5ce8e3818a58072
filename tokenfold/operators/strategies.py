"""Eviction strategies as one number per message.

``need`` is the smallest budget under which a message of an overfull block stays. It depends on
running sums only, never on the budget, so budgets can be carried from block to block afterwards
and eviction is the filter ``need <= budget``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A need that no budget meets.
NEVER = (1 << 62)

BLOCK = ["build_id", "block_ord"]


@dataclass(frozen=True)
class Strategy:
    """What an overfull block does; ``on_empty`` is the error if nothing stays, ``min_messages`` the fewest that may."""

    on_empty = None
    min_messages = 0

    def need(self) -> Column | None:
        """``need`` over rows (build_id, block_ord, pos, role, message, w, total), by windows over the block; None if it takes more."""
        return F.lit(NEVER)

    def with_need(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``need``, where ``need()`` is None."""
        raise NotImplementedError


@dataclass(frozen=True)
class Strict(Strategy):
    """An overfull block fails its build."""

    on_empty = "BUDGET_EXCEEDED"


@dataclass(frozen=True)
class Drop(Strategy):
    """An overfull block is left out."""


@dataclass(frozen=True)
class DropTail(Strategy):
    """The longest fitting prefix stays; the build fails if not even the first message fits."""

    on_empty = "BLOCK_TOO_LARGE"

    def need(self) -> Column:
        return F.sum("w").over(Window.partitionBy(*BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))


@dataclass(frozen=True)
class DropHead(Strategy):
    """Messages go from the front until the rest fits.

    Messages of ``protected`` roles stay; with ``atomic_turns`` an assistant's tool calls and the
    tool results after it go together, whatever is protected. A block that can't be made to fit,
    or keeps fewer than ``min_messages``, is left out.
    """

    atomic_turns: bool = False
    min_messages: int = 0
    protected: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "min_messages", max(0, self.min_messages))
        object.__setattr__(self, "protected", tuple(dict.fromkeys(r for r in self.protected if r)))

    def _units(self, rows: DataFrame) -> DataFrame:
        """``unit``: the place of the first message of what goes together; null for what never goes."""
        held = F.col("role").isin(*self.protected) if self.protected else F.lit(False)
        if not self.atomic_turns:
            return rows.withColumn("unit", F.when(~held, F.col("pos")))
        ordered = Window.partitionBy(*BLOCK).orderBy("pos")
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        starts = (F.row_number().over(ordered) == 1) | (F.col("role") != "tool")
        runs = rows.withColumn("run", F.sum(starts.cast("int")).over(upto))
        run = Window.partitionBy(*BLOCK, "run").orderBy("pos")
        within = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = run.rowsBetween(Window.unboundedPreceding, -1)
        calls = F.coalesce(F.col("message.ToolCalls"), F.array().cast(rows.schema["message"].dataType["ToolCalls"].dataType))
        result = F.coalesce(F.col("message.ToolCallID"), F.lit(""))
        headed = runs.select(
            "*",
            F.first("pos").over(within).alias("head"),
            F.first(F.size(calls)).over(within).alias("n_calls"),
            F.first((F.col("role") == "assistant") & (F.size(calls) > 0) & ~held).over(within).alias("turn"),
            F.first(F.array_distinct(F.filter(F.transform(calls, lambda c: c["id"]), lambda i: i != ""))).over(within).alias("ids"),
            (F.row_number().over(run) - 1).alias("k"),
            result.alias("result"),
        )
        same = Window.partitionBy(*BLOCK, "run", "result").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        later = headed.withColumn("seen", F.coalesce(F.sum((F.col("k") > 0).cast("int")).over(same), F.lit(0)))
        bad = (F.col("k") > 0) & (F.col("result") != "") & (~F.array_contains("ids", F.col("result")) | (F.col("seen") > 0))
        flagged = later.withColumn("bad", bad.cast("int")).withColumn(
            "matched", F.sum(((F.col("k") > 0) & (F.col("result") != "")).cast("int")).over(within)
        )
        done = ((F.col("k") >= F.col("n_calls")) & (F.col("matched") == F.size("ids"))).cast("int")
        closed = flagged.withColumn("done", done)
        inside = (
            F.col("turn")
            & (F.max("bad").over(within) == 0)
            & (F.coalesce(F.max(F.when(F.col("k") > 0, F.col("done"))).over(before), F.lit(0)) == 0)
        )
        unit = F.when(inside, F.col("head")).when(~held, F.col("pos"))
        return closed.withColumn("unit", unit).select(*rows.columns, "unit")

    def need(self) -> Column | None:
        if self.atomic_turns:
            return None
        held = F.coalesce(F.col("role").isin(*self.protected), F.lit(False)) if self.protected else F.lit(False)
        before = Window.partitionBy(*BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        gone = F.coalesce(F.sum(F.when(~held, F.col("w"))).over(before), F.lit(0))
        floor = F.sum(F.when(held, F.col("w")).otherwise(0)).over(Window.partitionBy(*BLOCK))
        return F.when(held, floor).otherwise(F.col("total") - gone)

    def with_need(self, rows: DataFrame) -> DataFrame:
        units = self._units(rows)
        kind = units.withColumn("fixed", F.col("unit").isNull())
        before = Window.partitionBy(*BLOCK, "fixed").orderBy("unit").rangeBetween(Window.unboundedPreceding, -1)
        gone = F.coalesce(F.sum("w").over(before), F.lit(0))
        floor = F.sum(F.when(F.col("fixed"), F.col("w")).otherwise(0)).over(Window.partitionBy(*BLOCK))
        need = F.when(F.col("fixed"), floor).otherwise(F.col("total") - gone)
        return kind.withColumn("need", need).drop("unit", "fixed")


@dataclass(frozen=True)
class Summarize(Strategy):
    """An overfull block becomes one message, if that fits.

    ``summarizer`` makes it from the block's messages in order (an array Column).
    """

    summarizer: Callable[[Column], Column]

    def __post_init__(self):
        if self.summarizer is None:
            raise ValueError("a summarizer is needed")


@dataclass(frozen=True)
class Custom(Strategy):
    """Any strategy in Python: ``apply`` gets an overfull block as a pandas frame (pos, message as
    a dict, w), its tokens and the limit, and returns a frame of pos and message."""

    apply: Callable
    on_empty = None


def wrapped(strategy: Custom, *middleware: Callable[[Callable], Callable]) -> Custom:
    """``strategy`` inside decorators, of which the first is outermost."""
    apply = strategy.apply
    for layer in reversed(middleware):
        apply = layer(apply)
    return Custom(apply)
