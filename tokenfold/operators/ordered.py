"""Running values over groups of any size.

A window over a group puts the group into one task. Here rows are dealt by range over group and order,
so that a large group spans many parts; a window runs within a part's share of a group, and what came
before is one carried row per part and group. Only groups of several parts have carried rows, so there
are fewer than twice as many as parts: they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenfold.sources.shared import written


def dealt(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` written in order of group and order, with ``place``, a number that rises in this order, and ``part``."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(count, *group, *order).sortWithinPartitions(*group, *order).withColumn("place", F.monotonically_increasing_id())
    return written(placed.withColumn("part", F.shiftright("place", 33).cast("int")), "dealt")


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("place")))


#: Per kind: the value over rows in a window, over a share of a group, and of earlier and own rows together.
_KINDS = {
    "sum": (F.sum, F.sum, F.sum, lambda earlier, own: F.coalesce(earlier, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "max": (F.max, F.max, F.max, lambda earlier, own: F.greatest(earlier, own)),
    "last": (lambda v: F.last(v, ignorenulls=True), _last, lambda v: F.last(v, ignorenulls=True), lambda earlier, own: F.coalesce(own, earlier)),
}


def running(rows: DataFrame, group: list[str], name: str, kind: str, value: Column, inclusive: bool = True) -> DataFrame:
    """Dealt ``rows`` with ``name``: the ``kind`` (sum, max, or last that isn't null) of ``value`` over the group's rows up to this one.

    Without ``inclusive`` the row itself doesn't count.
    """
    over_rows, over_share, over_shares, joined = _KINDS[kind]
    share = Window.partitionBy("part", *group).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    own = rows.withColumn("_own", over_rows(value).over(share))
    shares = rows.groupBy("part", *group).agg(over_share(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = shares.withColumn("_earlier", over_shares("_total" if kind == "sum" else F.col("_total")).over(before)).filter(F.col("_earlier").isNotNull())
    both = own.join(F.broadcast(carried.drop("_total")), ["part", *group], "left")
    return both.withColumn(name, joined(F.col("_earlier"), F.col("_own"))).drop("_own", "_earlier").select(*rows.columns, name)


def following(rows: DataFrame, group: list[str], order: list[str], wanted: Column, target: Column, keep: list[str]) -> DataFrame:
    """As-of lookup forward: of the rows that are ``wanted``, ``keep`` and ``found``, the next row's ``target`` that isn't null.

    ``order`` must rise; the lookup runs against it, from the group's end. A row doesn't find itself.
    """
    kept = F.struct(*keep).alias("_kept")
    backward = rows.select(*group, *[(-F.col(c)).alias(f"_against_{c}") for c in order], wanted.alias("_wanted"), target.alias("_target"), kept)
    found = running(dealt(backward, group, [f"_against_{c}" for c in order]), group, "found", "last", F.col("_target"), inclusive=False)
    return found.filter("_wanted").select("_kept.*", "found")
