"""Parts of exact set-similarity joins: an order of hashed items by rarity, prefixes of sets, parities.

Any total order gives the same result. It is made from counts in shared counters, rare items first, so
that hardly any item of a prefix is in many sets.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.llm.common import written

#: Counters of the words' frequencies; what is held of them is 2 bytes each. Words share counters; any total order of words
#: gives the same result, so this number only decides how selective the prefixes are.
COUNTERS = 1 << 21

#: Flags by which most rows that a small table cannot have are told before a join.
FLAGS = 1 << 20

#: Bits of an item's hash; its rarity is above them in the same integer.
HASH_BITS = 52

_CHUNK = 4096


def hashed(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def slot(value: Column, size: int) -> Column:
    """``size`` is a power of two."""
    return value.bitwiseAND(F.lit(size - 1)).cast("int")


def array_of_counts(values: DataFrame, size: int, of: Callable[[Column], Column] = lambda n: n.cast("int")) -> Column:
    """One array of ``size`` entries, made of the counts of the slots of the column ``value``, as a scalar for any plan.

    It is put together from chunks, and what the driver and each task hold is ``size`` numbers.
    """
    spark = values.sparkSession
    counted = values.groupBy(slot(F.col("value"), size).alias("at")).agg(F.count("*").alias("n"))
    every = spark.range(size).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("n"))
    chunk = F.floor(F.col("at") / _CHUNK).cast("int")
    filled = counted.unionByName(every).groupBy("at").agg(F.sum("n").alias("n")).withColumn("chunk", chunk)
    chunks = filled.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("held"))
    plain = chunks.select("chunk", F.transform("held", lambda x: of(x["n"])).alias("held"))
    one = plain.agg(F.array_sort(F.collect_list(F.struct("chunk", "held"))).alias("all"))
    return written(one.select(F.flatten(F.transform("all", lambda x: x["held"])).alias("counts")), "counts").scalar()


def levels(values: DataFrame, counters: int) -> Column:
    """Per counter the rarity of the items it counts (60 for a count of one); the column ``value`` holds all items."""
    return array_of_counts(values, counters, lambda n: F.floor(F.log2(n + F.lit(1.0)) * 60).cast("smallint"))


def flags(values: DataFrame) -> Column:
    """A flag per slot that a ``value`` falls into."""
    return array_of_counts(values, FLAGS, lambda n: (n > 0).cast("tinyint"))


def flagged(flags: Column, value: Column) -> Column:
    return F.get(flags, slot(value, FLAGS)) > 0


def key(levels: Column, item: Column, counters: int) -> Column:
    """An item's place in the order: its rarity above its hash."""
    return F.shiftleft(F.get(levels, slot(item, counters)).cast("long"), HASH_BITS).bitwiseOR(item)


def prefix(n: Column, similarity: tuple[int, int]) -> Column:
    """How many of a set's rarest words hold one of any set that matches it."""
    top, bottom = similarity
    return n - F.ceil(top * n / bottom) + 1


def short_prefix(n: Column, similarity: tuple[int, int]) -> Column:
    """The same for sets that are no smaller: these have more words in common with it."""
    top, bottom = similarity
    return n - F.ceil(2 * top * n / (top + bottom)) + 1


def one_bit(key: Column) -> Column:
    """A long with one bit set, chosen by the word's hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(key, 11).bitwiseAND(F.lit(63)).cast("int"))


def parities(keys: Column, count: int) -> Column:
    """``count`` longs (a power of two), each of the bits of the words dealt to it; of two sets no more bits differ than words."""

    def dealt(i: int) -> Column:
        own = F.filter(keys, lambda k: F.shiftright(k, 17).bitwiseAND(F.lit(count - 1)) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda held, k: held.bitwiseXOR(one_bit(k)))

    return F.array(*[dealt(i) for i in range(count)])


def differing(a: Column, b: Column, count: int) -> Column:
    """In how many bits two such arrays differ; null if one of them is."""
    return functools.reduce(operator.add, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(count)])
