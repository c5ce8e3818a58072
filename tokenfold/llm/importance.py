"""Quality by importance resampling: hashed n-gram models of target and raw text.

A text's weight is the ratio of its probabilities under two bag-of-n-grams models, one of labelled
good texts and one of all texts. Adding Gumbel noise to the logarithm of the weights and taking the
k largest draws k texts without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.llm.common import SPACE_CLASS, releasing, written

#: Hash buckets of words and of word pairs together.
BUCKETS = 1 << 15

#: Labelled rows that the target model is fitted on, at most; the smallest by a hash of doc_id.
FIT_ROWS = 20_000

#: Added to every bucket of both models.
SMOOTHING = 1.0

#: Seed of the Gumbel noise.
SEED = 17

#: Keys that the search for the k-th largest may gather at last.
LAST_KEYS = 10_000


def _features(batch: pa.RecordBatch, at: int):
    """Buckets of all n-grams of a batch, and where each row's begin and end."""
    import numpy as np

    lists = batch.column(at)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(sizes)
    single = (words >> np.uint64(20)) % np.uint64(BUCKETS)
    double = np.zeros(len(words), np.uint64)
    if len(words) > 1:
        double[:-1] = ((words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) >> np.uint64(20)) % np.uint64(BUCKETS)
    paired = np.ones(len(words), bool)
    paired[ends[sizes > 0] - 1] = False  # no pair crosses from one text to the next
    return single.astype(np.int64), double.astype(np.int64), paired, sizes, ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of both models as one row each."""
    import numpy as np

    totals = np.zeros((2, BUCKETS), np.int64)
    seen = False
    for batch in batches:
        seen = True
        single, double, paired, sizes, _ = _features(batch, 1)
        good = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(bool), sizes)
        totals[0] += np.bincount(single, minlength=BUCKETS) + np.bincount(double[paired], minlength=BUCKETS)
        totals[1] += np.bincount(single[good], minlength=BUCKETS) + np.bincount(double[paired & good], minlength=BUCKETS)
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS)), pa.array(totals[0]), pa.array(totals[1])], ["bucket", "raw", "target"]
        )


def _weigh(ratios: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # In whole steps of 2**-32, so that a text's weight does not depend on the rows beside it.
        ratio = np.rint(np.array(ratios) * 2.0**32).astype(np.int64)
        for batch in batches:
            single, double, paired, sizes, ends = _features(batch, 1)
            each = ratio[single] + np.where(paired, ratio[double], 0)
            total = np.concatenate(([0], np.cumsum(each)))
            weights = (total[ends] - total[ends - sizes]) / 2.0**32
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(weights)], ["doc_id", "n_words", "log_weight"])

    return run


def _hashed(docs: DataFrame, *columns) -> DataFrame:
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), f"{SPACE_CLASS}+"), "")
    return docs.select(*columns, F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[float], float]:
    """Log ratio of target to raw probability per bucket, and the labelled rows' share of good ones.

    The raw counts are those of all texts; the target's of at most ``rows`` labelled ones, whose
    ids are broadcast. Without labels all ratios are 0 and the share is 1.
    """
    usable = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    share = chosen.agg(F.avg("quality")).first()[0]
    good = chosen.filter("quality = 1").select("doc_id", F.lit(True).alias("good"))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left")
    counts = _hashed(marked, F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(releasing(_count), "bucket long, raw long, target long")
    held = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    if share is None or not sum(r.target for r in held):
        return [0.0] * BUCKETS, 1.0
    import numpy as np

    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for r in held:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).tolist(), float(share)


def weights(docs: DataFrame, ratios: list[float], seed: int = SEED) -> DataFrame:
    """One row per document row: doc_id, n_words, log_weight and key, the weight with Gumbel noise.

    Null, empty and wordless texts have log_weight 0. The noise is a function of doc_id and seed,
    so repeated rows have one key.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("log_weight", T.DoubleType())]
    )
    weighed = _hashed(docs, "doc_id").mapInArrow(releasing(_weigh(ratios)), schema)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of the column ``key``; None if there are no k keys.

    Counts in a thousand equal bins narrow the range until few keys are left in it, and only those
    come to the driver.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or n < k:
        return None
    above = 0
    while True:
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        if n <= LAST_KEYS:
            return sorted((r.key for r in inside.select("key").collect()), reverse=True)[k - above - 1]
        if low == high:
            return low
        width = (high - low) / 1000
        bins = F.least(F.floor((F.col("key") - low) / F.lit(width)), F.lit(999)).alias("bin")
        counts = inside.groupBy(bins).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r.bin):
            if above + r.n >= k:
                low, high, n = r.low, r.high, r.n
                break
            above += r.n


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, log_weight, key, and whether it is drawn.

    ``share`` of the rows are drawn, by default the share of good ones among the labels. Rows that
    tie with the last one drawn are drawn too. An empty table gives no rows.
    """
    ratios, good = fit(docs, labels)
    keyed = written(weights(docs, ratios), "weights")
    k = round((good if share is None else share) * keyed.count())
    least = kth_largest(keyed, k)
    return keyed.withColumn("selected", F.lit(False) if least is None else F.col("key") >= F.lit(least))
