"""Importance resampling against plain Python: log weights, keys and the cut."""

import math
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tokenfold.llm import importance


def _buckets(text):
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in text.lower().split()]
    pairs = [(a * 0x9E3779B97F4A7C15 + b) % (1 << 64) for a, b in zip(hashes, hashes[1:])]
    return [(h >> 20) % importance.BUCKETS for h in [*hashes, *pairs]]


def test_weights_keys_and_cut(spark):
    good = "the river runs to the sea under a clear sky"
    texts = [good if k % 3 else f"buy now cheap pills {k % 7}" for k in range(60)] + ["", None, "  ", good * 200]
    rows = [*enumerate(texts), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(40)], "doc_id long, quality int")
    raw, target = Counter(), Counter()
    for i, text in rows:
        own = Counter(_buckets(text or ""))
        raw += own
        if i < 40 and i % 3:
            target += own
    total = [sum(c.values()) + importance.SMOOTHING * importance.BUCKETS for c in (raw, target)]

    def log_weight(text):
        smooth = importance.SMOOTHING
        return sum(math.log((target[b] + smooth) / total[1]) - math.log((raw[b] + smooth) / total[0]) for b in _buckets(text or ""))

    got = importance.resample(docs, labels).withColumn("noise", F.xxhash64(F.lit(importance.SEED), F.col("doc_id").cast("string"))).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        uniform = (((r.noise % (1 << 64)) >> 11) + 0.5) / 2.0**53
        assert math.isclose(r.log_weight, log_weight(by_id[r.doc_id]), rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(r.key, r.log_weight - math.log(-math.log(uniform)), rel_tol=1e-12, abs_tol=1e-9)
    k = round(sum(i % 3 > 0 for i in range(40)) / 40 * len(rows))
    least = sorted((r.key for r in got), reverse=True)[k - 1]
    assert all(r.selected == (r.key >= least) for r in got) and len({r.key for r in got if r.doc_id == 3}) == 1
