"""Lloyd's clustering in exact whole numbers, each assignment by an Exponion search.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of the
distance to any other. Where the bounds can't settle that its own is strictly the nearest, only the
centroids in a ball around its own are scanned, in order of their distance to it. With ``u`` the
distance to the own centroid and ``s`` that of the own centroid to its nearest fellow, the nearest
and the second nearest lie within ``2 u + s`` of the own one. The radius is inclusive and every
bound errs on the safe side, so ties are met and go to the smaller number.

Vectors lie in blocks, written once in buckets by block. The bounds are a second, thin table in the
same buckets: a round joins both where they lie, without a shuffle, and writes bounds only. Sums of
the centroids change by what has moved, in whole numbers, so they don't drift.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenfold.llm.common import Scratch, releasing, written
from tokenfold.llm.vectors import finite, unpacked, whole, widest

CENTROIDS, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024

#: Vectors of a block, the unit of reading and of a bound's record.
BLOCK = 1024

#: Blocks of a batch that goes to Python: at most 16 MB of 64 components.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}

#: By how much bounds in floating point are widened.
SLACK = 1e-9


@dataclass(frozen=True)
class Clustering:
    """``rows``: vec_id, cluster, distance (squared). ``centroids``: components per number.
    ``inertia``: the sum of distances per cluster. ``scanned``: distances computed, of all rounds."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]
    scanned: int


def _packed(scale: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, vector) to blocks: a number, the ids, and the vectors as int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held = whole(part.column(1), scale, dims, min(widest(dims), (1 << 31) - 1)).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), ids, pa.array([held.tobytes()], pa.binary())], ["block", "ids", "vectors"]
                )
                number += 1

    return run


def _squares(x, c):
    """Squared distances of the rows of ``x`` to one centroid, exact."""
    import numpy as np

    away = x - c
    return np.einsum("ij,ij->i", away, away)


def _ball_search(x, own, upper, radius_of, order, between, centres):
    """Nearest centroid, its squared distance and the second's for rows that share the centroid ``own``.

    Only centroids within the radius of ``own`` are scanned, by ``order``, which sorts them by distance.
    """
    import numpy as np

    reach = np.searchsorted(between, radius_of * (1 + SLACK) + SLACK, side="right")
    best = np.full(len(x), own)
    first, second = upper.copy(), np.full(len(x), np.iinfo(np.int64).max)
    scanned = 0
    for place in range(len(order)):
        near = np.flatnonzero(reach > place)
        if not len(near):
            break
        j = order[place]
        if j == own:
            continue
        scanned += len(near)
        d = _squares(x[near], centres[j])
        wins = (d < first[near]) | ((d == first[near]) & (j < best[near]))
        second[near] = np.where(wins, first[near], np.minimum(second[near], d))
        first[near] = np.where(wins, d, first[near])
        best[near] = np.where(wins, j, best[near])
    return best, first, second, scanned


def _assign(x, state, centres, moves):
    """One assignment of a block: clusters, bounds and how many distances were computed.

    ``state`` is (cluster, upper, lower) of the round before, or None in the first round.
    """
    import numpy as np

    k = len(centres)
    away = np.sqrt(np.array([_squares(centres, c) for c in centres], np.float64))
    if state is None:
        cluster, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    else:
        cluster, upper, lower = (a.copy() for a in state)
        others = np.array([max(np.delete(moves, j), default=0.0) for j in range(k)])
        upper += moves[cluster]
        lower -= others[cluster]
    fellow = np.where(np.eye(k, dtype=bool), np.inf, away).min(1)
    bar = np.maximum(lower, fellow[cluster] / 2) * (1 - SLACK)
    due = np.flatnonzero(~(upper * (1 + SLACK) < bar))
    exact = np.zeros(len(x), np.int64)
    for j in range(k):
        mine = due[cluster[due] == j]
        exact[mine] = _squares(x[mine], centres[j])
    scanned = len(due)
    upper[due] = np.sqrt(exact[due]) * (1 + SLACK)
    due = due[~(upper[due] < bar[due])]
    order = np.argsort(away, axis=1, kind="stable")
    was = cluster[due]
    for j in np.unique(was):
        mine = due[was == j]
        if k == 1:
            lower[mine] = np.inf
            continue
        best, first, second, count = _ball_search(x[mine], j, exact[mine], 2 * upper[mine] + fellow[j], order[j], away[j][order[j]], centres)
        cluster[mine], upper[mine] = best, np.sqrt(first) * (1 + SLACK)
        lower[mine] = np.sqrt(second.astype(np.float64)) * (1 - SLACK)
        scanned += count
    return cluster, upper, lower, scanned


def _round(centres: list[list[int]], moves: list[float], dims: int) -> Callable:
    """A round's task: rows (block, vectors[, cluster, upper, lower]) to the new state and the change of sums.

    ``change`` has, per centroid, its count and its component sums; null where no vector moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c, k = np.array(centres, np.int64), len(centres)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                x = unpacked(batch.column(1)[i], np.int32, dims).astype(np.int64)
                old = state = None
                if batch.num_columns > 2:
                    state = tuple(unpacked(batch.column(2 + n)[i], kind).astype(wide) for n, (kind, wide) in enumerate(_STATE))
                    old = state[0]
                cluster, upper, lower, scanned = _assign(x, state, c, np.array(moves))
                moved = np.ones(len(x), bool) if old is None else cluster != old
                change = None
                if moved.any():
                    change = np.zeros((k, dims + 1), np.int64)
                    for j in range(k):
                        came = moved & (cluster == j)
                        change[j] += np.append(came.sum(), x[came].sum(0))
                        if old is not None:
                            gone = moved & (old == j)
                            change[j] -= np.append(gone.sum(), x[gone].sum(0))
                    change = change.ravel().tolist()
                held = [a.astype(kind).tobytes() for a, (kind, _) in zip((cluster, upper, lower), _STATE)]
                out.append((batch.column(0)[i].as_py(), *held, scanned, change))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], _ROUND_NAMES)

    return run


#: How the state's arrays are kept, and as what they are worked with.
_STATE = (("<i4", "int64"), ("<f8", "float64"), ("<f8", "float64"))
_ROUND_NAMES = ["block", "cluster", "upper", "lower", "scanned", "change"]
_ROUND = "block long, cluster binary, upper binary, lower binary, scanned long, change array<bigint>"


def _distances(centres: list[list[int]], dims: int) -> Callable:
    """Blocks with their last clusters to rows: id, cluster, squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = np.array(centres, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                x = unpacked(batch.column(1)[i], np.int32, dims).astype(np.int64)
                cluster = unpacked(batch.column(2)[i], np.int32)
                away = x - c[cluster]
                d = np.einsum("ij,ij->i", away, away)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(cluster), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "3:") -> Clustering:
    """Clusters of the vectors (vec_id, embedding) with exactly ``dims`` components, none null or non-finite.

    A component x counts as ``floor(scale * x)``. The first centroids are the ``k`` vectors (fewer, if
    there are fewer) with the smallest sha256 of ``seed`` and the id, then by id and components; a null
    id comes last. A centroid becomes the floor of its vectors' mean per component, an empty one stays.
    Repeated rows and ids are vectors of their own, each with a row in the result; an empty table, or one
    without such vectors, has no centroids and no rows. Further columns are ignored. Components beyond
    what squared distances in a long allow (2^27 for 64 components) raise an error.
    """
    spark = vectors.sparkSession
    held = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    held = held.filter((F.size("vector") == dims) & finite(F.col("vector")))
    id_type = held.schema["vec_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = held.orderBy(digest.asc_nulls_last(), "vec_id", "vector").limit(k).collect()
    if not first:
        return Clustering(spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), [], [], 0)
    centres = [[math.floor(scale * x) for x in row.vector] for row in first]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch:
        packed = held.mapInArrow(releasing(_packed(scale, dims)), f"block long, ids array<{id_type}>, vectors binary")
        blocks = scratch.bucketed(packed.repartition(parts, "block"), "blocks", "block", parts)
        state, scanned, moves = None, 0, [0.0] * len(centres)
        sums = [[0] * (dims + 1) for _ in centres]
        for number in range(rounds + 1):
            thin = blocks.select("block", "vectors")
            met = thin if state is None else thin.join(state.select("block", "cluster", "upper", "lower").hint("merge"), "block").select("block", "vectors", "cluster", "upper", "lower")
            state = scratch.bucketed(met.mapInArrow(releasing(_round(centres, moves, dims)), _ROUND), "bounds", "block", parts, BATCH)
            scanned += state.agg(F.sum("scanned")).first()[0] or 0
            if number == rounds:
                break
            changes = state.select(F.posexplode("change").alias("place", "value")).groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
            for row in changes.collect():
                sums[row.place // (dims + 1)][row.place % (dims + 1)] += int(row.value)
            after = [[total // row[0] for total in row[1:]] if row[0] else c for row, c in zip(sums, centres)]
            moves = [math.sqrt(sum((a - b) ** 2 for a, b in zip(c, d))) * (1 + SLACK) for c, d in zip(centres, after)]
            centres = after
        met = blocks.join(state.select("block", "cluster").hint("merge"), "block").select("ids", "vectors", "cluster")
        rows = written(met.mapInArrow(releasing(_distances(centres, dims)), f"vec_id {id_type}, cluster int, distance long"), "clusters", BATCH)
    totals = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    return Clustering(rows, centres, [totals.get(j, 0) for j in range(len(centres))], scanned)


def digests(made: Clustering) -> DataFrame:
    """``made``'s rows with cluster_inertia, inertia and centroid_sha256; the facts joined are one row a centroid."""
    spark = made.rows.sparkSession
    facts = [(j, made.inertia[j], sum(made.inertia), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(made.centroids)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
