"""Token counters: an additive weight of one message, as a Column; or besides it a count of a whole list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenfold.errors import ContextError

#: Tokens of a part without text, and of a tool call besides its text (fixed values).
NON_TEXT_TOKENS, CALL_TOKENS = 85, 20


class TokenCounter(Protocol):
    def weight(self, message: Column) -> Column:
        """Tokens of a message, a non-negative long; a pandas UDF will do."""


class ListCounter(Protocol):
    """A counter whose tokens of a list need not be the sum of its messages'.

    A build under it counts every block, everything that stays, and the final messages as lists; drop-head
    goes by the weights, and what it leaves is counted again. ``grows = False`` says that a longer
    list may have fewer tokens.
    """

    def weight(self, message: Column) -> Column:
        """Tokens of a message by itself."""

    def count(self, messages: Column) -> Column:
        """Tokens of an array of messages, a non-negative long; a pandas UDF will do."""


def bad_count(tokens: Column) -> Column:
    """A number of tokens that no counter may give."""
    return tokens.isNull() | (tokens < 0)


def _total(array: Column, each: Callable[[Column], Column]) -> Column:
    none = F.lit(0).cast("long")
    return F.coalesce(F.aggregate(array, none, lambda held, x: held + F.coalesce(each(x), none)), none)


def _runes(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0)).cast("long")


@dataclass(frozen=True)
class CharCounter:
    """Characters per token, rounded up once per message.

    With an ``estimator`` (tool call to tokens) a call's name and arguments aren't counted as text.
    """

    chars_per_token: int
    non_text_tokens: int = NON_TEXT_TOKENS
    estimator: Callable[[Column], Column] | None = None

    def weight(self, message: Column) -> Column:
        per = self.chars_per_token
        if per <= 0:
            raise ContextError("INVALID_CHARS_PER_TOKEN")
        other = self.non_text_tokens if self.non_text_tokens > 0 else NON_TEXT_TOKENS
        runes = _runes(message["Name"]) + _total(
            message["Content"], lambda p: F.when(p["Type"] == "text", _runes(p["text"])).otherwise(F.lit(other * per))
        )
        calls = message["ToolCalls"]
        if self.estimator is None:
            runes = runes + _total(calls, lambda c: _runes(c["function"]["name"]) + _runes(c["function"]["arguments"]))
            spent = _total(calls, lambda c: F.lit(CALL_TOKENS))
        else:
            estimate = self.estimator
            spent = _total(calls, lambda c: F.lit(CALL_TOKENS) + estimate(c))
        return F.floor((runes + (per - 1)) / per).cast("long") + spent


@dataclass(frozen=True)
class FixedCounter:
    """So many tokens a message, a part and a tool call."""

    per_message: int
    per_part: int = 0
    per_call: int = 0

    def weight(self, message: Column) -> Column:
        def size(array: Column) -> Column:
            return F.coalesce(F.when(array.isNotNull(), F.size(array)), F.lit(0))

        return (
            F.lit(self.per_message) + size(message["Content"]) * self.per_part + size(message["ToolCalls"]) * self.per_call
        ).cast("long")


@dataclass(frozen=True)
class TurnCounter:
    """The weights of ``each`` and so many tokens where the role differs from the message before; a list
    that isn't empty has ``per_list`` besides. Counts grow with the list."""

    each: TokenCounter
    per_turn: int
    per_list: int = 0

    def weight(self, message: Column) -> Column:
        return self.each.weight(message)

    def count(self, messages: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("string").alias("role"))

        def add(held: Column, message: Column) -> Column:
            turns = held["role"].isNotNull() & (held["role"] != F.coalesce(message["Role"], F.lit("")))
            more = self.each.weight(message) + F.when(turns, self.per_turn).otherwise(0)
            return F.struct((held["sum"] + more).cast("long").alias("sum"), F.coalesce(message["Role"], F.lit("")).alias("role"))

        return F.aggregate(messages, start, add, lambda held: held["sum"]) + F.when(F.size(messages) > 0, self.per_list).otherwise(0)
