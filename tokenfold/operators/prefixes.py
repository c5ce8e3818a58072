"""The longest prefix that fits, under a counter of whole lists.

Such a counter has no running sums. Where counts don't fall as a list gets longer, all lists are searched
at once by halving: a round is one more column, and rounds are the binary digits of the longest list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenfold.functions.counters import ListCounter, bad_count


def longest_prefix(lists: DataFrame, counter: ListCounter, longest: int) -> DataFrame:
    """(build_id, n_stay, failed) of ``lists`` (build_id, list, budget), each of at most ``longest`` messages and too big as a whole.

    ``n_stay`` is the length of the longest shorter prefix whose count is within the budget, 0 if there is
    none of a message or more. ``failed``: a count that was asked for is null or negative. A counter whose
    counts may fall says so by ``grows = False``; then every prefix is counted.
    """
    if getattr(counter, "grows", True):
        at = lists.select("build_id", "list", "budget", F.lit(0).alias("low"), F.size("list").alias("high"), F.lit(False).alias("failed"))
        for _ in range(longest.bit_length()):
            middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
            probed = at.withColumn("middle", middle)
            asked = F.col("middle") > F.col("low")
            probed = probed.withColumn("got", counter.count(F.slice("list", F.lit(1), F.col("middle"))))
            within = F.col("got") <= F.col("budget")
            at = probed.select(
                "build_id", "list", "budget",
                F.when(asked & within, F.col("middle")).otherwise(F.col("low")).alias("low"),
                F.when(asked & ~within, F.col("middle")).otherwise(F.col("high")).alias("high"),
                (F.col("failed") | (asked & bad_count(F.col("got")))).alias("failed"),
            )
        return at.select("build_id", F.col("low").alias("n_stay"), "failed")
    lengths = F.sequence(F.lit(1), F.size("list") - 1)
    each = lists.select("build_id", "budget", F.size("list").alias("n"), "list").withColumn("length", F.explode_outer(F.when(F.col("n") > 1, lengths)))
    counted = each.withColumn("got", F.when(F.col("length").isNotNull(), counter.count(F.slice("list", F.lit(1), F.coalesce("length", F.lit(0))))))
    return counted.groupBy("build_id").agg(
        F.coalesce(F.max(F.when(F.col("got") <= F.col("budget"), F.col("length"))), F.lit(0)).alias("n_stay"),
        F.coalesce(F.max(F.col("length").isNotNull() & bad_count(F.col("got"))), F.lit(False)).alias("failed"),
    )
