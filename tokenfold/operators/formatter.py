"""Formatters: functions from the kept messages of builds to their final messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Formatter = Callable[[DataFrame], DataFrame]


class DefaultFormatter:
    """All messages in order of block and place, numbered from 0 in ``ordinal``."""

    def __call__(self, kept: DataFrame) -> DataFrame:
        order = Window.partitionBy("build_id").orderBy("block_ord", "pos")
        return kept.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))


def with_layers(formatter: Formatter, *middleware: Callable[[Formatter], Formatter]) -> Formatter:
    """``formatter`` inside decorators, of which the first is outermost."""
    for layer in reversed(middleware):
        formatter = layer(formatter)
    return formatter
