"""Clustering and hard negatives against plain Python, with nulls, ties, repeated rows and odd vectors."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tokenfold.llm import centroids, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, q string"


def _rows(count: int, dims: int, seed: int) -> list:
    """Rounded vectors, so that distances and scores tie, repeated rows and ids, and rows that take no part."""
    chance = random.Random(seed)
    rows = []
    for i in range(count):
        v = [round(chance.gauss(0, 0.02), 2) for _ in range(dims)]
        rows.append((i, v, chance.randrange(3), "x", "y"))
    rows += rows[:20] + [(0, rows[5][1], 1, None, None), (100, rows[6][1], 2, "x", "y")]
    rows += [(count, [0.01] * dims, 1, "x", "y")] * (count // 3)
    broken = [None, [], [None] + [0.0] * (dims - 1), [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [-math.inf] * dims]
    return rows + [(count + k, v, 1, None, None) for k, v in enumerate(broken, 1)] + [(7, rows[7][1], None, None, None), (None, rows[8][1], 0, None, None)]


def _single(x: float) -> float:
    """A number as single precision holds it."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def _whole(v, scale: int):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * _single(x)) for x in v]


def _lloyd(rows: list, k: int, rounds: int, dims: int):
    held = [(i, x) for i, x in ((r[0], _whole(r[1], 1024)) for r in rows) if x is not None and len(x) == dims]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centres = [list(x) for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in held]
        centres = [[sum(p) // len(own) for p in zip(*own)] if (own := [x for (_, x), a in zip(held, at) if a == j]) else c for j, c in enumerate(centres)]
    return [(i, j, d) for i, x in held for d, j in [nearest(x)]], centres


@pytest.mark.parametrize("count, dims, k, rounds, seed", [(300, 6, 8, 10, 1), (90, 3, 5, 4, 2), (40, 2, 1, 3, 3), (9, 4, 40, 2, 4)])
def test_clusters_equal_plain_rounds(spark, count, dims, k, rounds, seed):
    rows = _rows(count, dims, seed)
    made = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k, rounds, dims)
    wanted, centres = _lloyd(rows, k, rounds, dims)
    got = [tuple(r) for r in made.rows.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str) and made.centroids == centres
    assert made.inertia == [sum(d for _, j, d in wanted if j == n) for n in range(len(centres))]
    facts = centroids.digests(made).filter("cluster = 0").first()
    assert facts.inertia == sum(made.inertia) and facts.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[0])).encode()).hexdigest()


def test_ball_search_skips_far_centroids(spark):
    chance = random.Random(5)
    rows = [(i, [100 * (i % 16) + chance.random() for _ in range(4)], 0, None, None) for i in range(2000)]
    made = centroids.cluster(spark.createDataFrame(rows, SCHEMA), 16, 6, 4)
    assert sorted(map(tuple, made.rows.collect())) == sorted(_lloyd(rows, 16, 6, 4)[0])
    assert made.scanned < 2000 * 16 * 7 / 3  # a third of what plain rounds compute


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None, 1, None, None), (2, [0.5], 1, None, None)]):
        made = centroids.cluster(spark.createDataFrame(rows, SCHEMA))
        assert made.rows.count() == 0 and made.centroids == [] and centroids.digests(made).count() == 0


def test_components_beyond_the_limit_are_refused(spark):
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64, 1, None, None)], SCHEMA))


def _mined(rows: list, every: int) -> list:
    held = [(r[0], r[2], _whole(r[1], 256)) for r in rows]
    held = [(i, y, x) for i, y, x in held if i is not None and y is not None and x is not None]
    out = []
    for n, (i, y, x) in enumerate(held):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, z)), j, w) for m, (j, w, z) in enumerate(held) if m != n]
        for s, p in sorted((s, j) for s, j, w in scored if w == y)[:5]:
            fits = sorted((t, j) for t, j, w in scored if w != y and -30 * s <= -100 * t <= -90 * s)[:10]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("count, dims, seed", [(400, 6, 1), (60, 2, 2), (12, 3, 3)])
def test_negatives_equal_plain_search(spark, count, dims, seed):
    rows = _rows(count, dims, seed)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), every=20)
    assert sorted(map(tuple, got.collect())) == sorted(_mined(rows, 20))


def test_negatives_over_many_small_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELL_ROWS", 10)
    monkeypatch.setattr(negatives, "SLICE", 1)
    monkeypatch.setattr(negatives, "PACK", 3)
    chance = random.Random(8)
    rows = [(i, [3 * (i % 5) + chance.random() for _ in range(5)], i % 4, "x", "y") for i in range(700)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), every=35)
    assert sorted(map(tuple, got.collect())) == sorted(_mined(rows, 35))


def test_negatives_of_nothing(spark):
    for rows in ([], [(100, None, 1, None, None), (200, [0.5], None, None, None)], [(100, [0.5], 1, None, None)]):
        assert negatives.mine(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(101, [0.5], 1, None, None)], SCHEMA)).columns == "anchor_id positive_id rank negative_id positive_score negative_score".split()


def test_extra_columns_do_not_clash(spark):
    rows = spark.createDataFrame(_rows(50, 3, 9), SCHEMA).withColumns({"pivot": F.lit(1), "distance": F.lit("d"), "slot": F.lit(2)})
    assert centroids.cluster(rows, 3, 2, 3).rows.columns == ["vec_id", "cluster", "distance"]
    assert negatives.mine(rows, every=20).count() == len(_mined(_rows(50, 3, 9), 20))
