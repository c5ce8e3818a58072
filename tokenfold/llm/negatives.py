"""Hard-negative mining by one-dimensional distance keys.

An inner product becomes a distance: a vector gets one more component, which brings its length to
that of the longest, an anchor gets a zero there, and the nearest rows have the highest scores.
Rows are stored sorted by label, pivot and key, the key being the distance to their nearest pivot.
By the triangle inequality no row whose key differs by more than ``w`` from the anchor's distance to
the pivot is nearer than ``w``. So a search scans the key interval of half-width ``w`` around each
pivot's distance, and widens it by annuli until the worst of the top-k found is within ``w``.

An interval is read in cells, which are ranges of a pivot's keys. Their number is bounded, so each
anchor asks for its cells by a lookup in a small directory; anchors of a cell come in packs and meet
the cell's chunks of rows in slices, so that neither a crowded cell nor a common vector, label or
anchor ends in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenfold.llm.common import Scratch, releasing, written
from tokenfold.llm.vectors import finite, unpacked, whole

#: Of the contract: scale of components, anchors, positives, negatives, and the bounds of a negative's score in percent of the positive's.
SCALE, ANCHORS, POSITIVES, NEGATIVES, PERCENT = 256, 100, 5, 10, (30, 90)

#: Pivots, the most cells of a pivot, and how many rows make another cell.
PIVOTS, CELLS, CELL_ROWS = 4, 64, 8192

#: Rows of a chunk, chunks of a slice (on average), anchors of a pack (on average).
CHUNK, SLICE, PACK = 1024, 32, 256

#: Pairs of a pack and a chunk that go to Python at once: about 12 MB.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "32"}

#: Half-open windows of scores have this as their end.
FAR = 1 << 62

#: By which part of the longest vector bounds in floating point are widened.
SLACK = 1e-6

_LEAST = -(1 << 63)


@dataclass(frozen=True)
class Keys:
    """What a search knows of the stored rows: pivots with their last component, the square of the longest
    vector, components per vector, and per cell (pivot, cell, lowest and highest key, chunks)."""

    pivots: list[list[int]]
    last: list[float]
    square: float
    dims: int
    directory: list[tuple[int, int, float, float, int]]

    @property
    def slack(self) -> float:
        return SLACK * math.sqrt(self.square) + SLACK


def _placed(keys: Keys, edges: dict[int, list[float]]) -> Callable:
    """Rows (vec_id, label, vector) with nearest pivot, cell, key and the vector as int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pivots, last = np.array(keys.pivots, np.float64), np.array(keys.last)
        for batch in batches:
            held = whole(batch.column(2), SCALE, keys.dims, _limit(keys.dims))
            x = held.astype(np.float64)
            own = np.sqrt(np.maximum(keys.square - (x * x).sum(1), 0))
            away = np.sqrt(np.maximum(2 * keys.square - 2 * x @ pivots.T - 2 * own[:, None] * last, 0))
            pivot = away.argmin(1) if len(x) else np.zeros(0, np.int64)
            key = away[np.arange(len(x)), pivot]
            cell = np.zeros(len(x), np.int32)
            for p, held_edges in edges.items():
                cell[pivot == p] = np.searchsorted(held_edges, key[pivot == p], side="right")
            blobs = pa.array([v.tobytes() for v in held.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(pivot.astype(np.int32)), pa.array(cell), pa.array(key), batch.column(0), blobs],
                ["label", "pivot", "cell", "key", "vec_id", "vector"],
            )

    return run


def _limit(dims: int) -> int:
    """The largest absolute component for which inner products are exact in floating point."""
    return math.isqrt((1 << 52) // max(1, dims))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to chunks of one label, pivot and cell."""
    import numpy as np

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        group = list(zip(*(batch.column(n).to_pylist() for n in range(3))))
        cuts = [0, *[n for n in range(1, len(group)) if group[n] != group[n - 1]], len(group)]
        for a, b in zip(cuts, cuts[1:]):
            for at in range(a, b, CHUNK):
                part = batch.slice(at, min(CHUNK, b - at))
                keys = part.column(3).to_numpy()
                ids = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), part.column(4))
                blob = b"".join(part.column(5).to_pylist())
                values = [*(pa.array([v], pa.int32()) for v in group[at][1:]), pa.array([number]), pa.array([float(np.min(keys))]), pa.array([float(np.max(keys))])]
                label = pa.array([group[at][0]], batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([label, *values, ids, pa.array([blob], pa.binary())], ["label", "pivot", "cell", "chunk", "lo", "hi", "ids", "vectors"])
                number += 1


def _store(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, Keys] | None:
    """The rows (vec_id, label, vector) in chunks by label, pivot and distance; None without rows."""
    spark = rows.sparkSession
    scaled = F.transform("vector", lambda x: F.floor(x * SCALE).cast("double"))
    norm = F.aggregate(scaled, F.lit(0.0), lambda held, x: held + x * x)
    count, dims, square = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(norm)).first()
    if not count:
        return None
    dims, square = max(1, dims), square * (1 + 1e-9) + 1
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(8 * PIVOTS).select("vector").collect()
    pivots = []
    for row in drawn:
        pivot = [math.floor(SCALE * x) for x in row.vector] + [0] * (dims - len(row.vector))
        if pivot not in pivots and len(pivots) < PIVOTS:
            pivots.append(pivot)
    last = [math.sqrt(max(0.0, square - sum(x * x for x in p))) for p in pivots]
    keys = Keys(pivots, last, square, dims, [])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    placed_as = f"label {types['label']}, pivot int, cell int, key double, vec_id {types['vec_id']}, vector binary"

    def placed(edges: dict[int, list[float]]) -> DataFrame:
        return rows.mapInArrow(releasing(_placed(keys, edges)), placed_as)

    cells = min(CELLS, count // (len(pivots) * CELL_ROWS) + 1)
    cuts = F.percentile_approx("key", [k / cells for k in range(1, cells)] or [0.5])
    edges = {r.pivot: sorted(set(r.cuts)) if cells > 1 else [] for r in placed({}).groupBy("pivot").agg(cuts.alias("cuts")).collect()}
    order = ["label", "pivot", "cell", "key", "vec_id"]
    dealt = placed(edges).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    chunks_as = f"label {types['label']}, pivot int, cell int, chunk long, lo double, hi double, ids array<{types['vec_id']}>, vectors binary"
    chunks = scratch.written(dealt.mapInArrow(releasing(_chunked), chunks_as), "chunks")
    listed = chunks.groupBy("pivot", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("chunks"))
    return chunks, replace(keys, directory=sorted(tuple(r) for r in listed.collect()))


def _anchors(every: int, dims: int) -> Callable:
    """Chunks to the anchors among their rows: place, id, label, vector and squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(2)[i].values
                at = np.flatnonzero(ids.to_numpy() % every == 0)
                x = unpacked(batch.column(3)[i], np.int32, dims)[at]
                label = pa.array([batch.column(0)[i].as_py()] * len(at), batch.schema.field(0).type)
                place = batch.column(1)[i].as_py() * CHUNK + at
                blobs = pa.array([v.tobytes() for v in x], pa.binary())
                norm = pa.array((x.astype(np.float64) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(place), ids.take(pa.array(at)), label, blobs, norm], ["q", "anchor_id", "label", "vector", "norm"])

    return run


def _asked(keys: Keys) -> Callable:
    """Anchors (q, vector, norm, nearest, done, wide) to the cells they scan next, as places in the directory.

    A cell is due if some row in it can be farther than ``done`` (the half-width scanned before), within
    ``wide``, and no nearer than ``nearest``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pivots = np.array(keys.pivots, np.float64)
        cell_of = np.array([r[0] for r in keys.directory])
        lo, hi = (np.array([r[n] for r in keys.directory]) for n in (2, 3))
        for batch in batches:
            norm, nearest, done, wide = (batch.column(n).to_numpy()[:, None] for n in (2, 3, 4, 5))
            x = np.stack([unpacked(v, np.int32) for v in batch.column(1)]).astype(np.float64) if batch.num_rows else np.zeros((0, keys.dims))
            away = np.sqrt(np.maximum(norm + keys.square - 2 * x @ pivots.T, 0))[:, cell_of]
            least = np.maximum(0, np.maximum(lo - away, away - hi))
            due = (least <= wide + keys.slack) & (least > done + keys.slack) & (hi + away >= nearest - keys.slack)
            cells = [np.flatnonzero(row).astype(np.int32) for row in due]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.int32()))], ["q", "cells"])

    return run


def _merged(held: tuple | None, found: tuple, k: int) -> tuple:
    """The k best of two sets of (score, id, place), rows of anchors by rank; ties by id, then place."""
    import numpy as np

    if held is not None:
        found = tuple(np.concatenate(pair, axis=1) for pair in zip(held, found))
    score, ident, place = found
    order = np.lexsort((place, ident, -score), axis=1)[:, :k]
    return tuple(np.take_along_axis(a, order, 1) for a in found)


def _scored(dims: int, k: int, same: bool) -> Callable:
    """Pairs of a pack and a chunk to the best rows per anchor and window: q, slot, score, vec_id, place.

    ``same``: rows of the anchor's label other than itself, else rows of other labels. What a pack finds
    in several chunks of a task is merged before it leaves.
    """

    def best_of(queries, low, high, labels, x, ids, label, first, q):
        import numpy as np

        score = (queries.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        order = np.lexsort((np.arange(len(ids)), ids))  # by id, then place
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        keys = score * CHUNK + (CHUNK - 1 - rank)
        fits = np.ones(score.shape, bool)
        if same:
            own = q[:, None] == first + np.arange(len(ids))
            fits &= ~own
        else:
            fits &= np.array([y != label for y in labels])[:, None]
        out = []
        for slot in range(low.shape[1]):
            open_ = fits & (score >= low[:, [slot]]) & (score <= high[:, [slot]])
            held = np.where(open_, keys, _LEAST)
            top = np.argpartition(held, max(0, len(ids) - k), axis=1)[:, -k:] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), score.shape)
            value = np.take_along_axis(score, top, 1)
            valid = np.take_along_axis(held, top, 1) != _LEAST
            out.append((np.where(valid, value, -FAR), ids[top], np.where(valid, first + top, -1)))
        return out

    def rows(q, found) -> pa.RecordBatch:
        import numpy as np

        parts = []
        for slot, (score, ident, place) in enumerate(found):
            i, j = np.nonzero(place >= 0)
            parts.append((q[i], np.full(len(i), slot, np.int32), score[i, j], ident[i, j], place[i, j]))
        names = ["q", "slot", "score", "vec_id", "place"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[bytes, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                pack = batch.column(0)[i].values
                q = pack.field("q").to_numpy()
                key = q.tobytes()
                if key not in held:
                    if len(held) >= 32:
                        yield rows(*held.pop(next(iter(held)))[:2])
                    windows = pack.field("windows")
                    n = int(windows.value_lengths().to_numpy().max())
                    bounds = []
                    for name, empty in (("low", FAR), ("high", -FAR)):
                        filled = np.full((len(q), n), empty, np.int64)
                        sizes = windows.value_lengths().to_numpy()
                        filled[np.arange(n) < sizes[:, None]] = windows.flatten().field(name).to_numpy()
                        bounds.append(filled)
                    queries = np.stack([unpacked(v, np.int32) for v in pack.field("vector")])
                    held[key] = (q, None, queries, *bounds, pack.field("label").to_pylist())
                _, found, queries, low, high, labels = held[key]
                x = unpacked(batch.column(4)[i], np.int32, dims)
                ids = batch.column(3)[i].values.to_numpy()
                new = best_of(queries, low, high, labels, x, ids, batch.column(1)[i].as_py(), batch.column(2)[i].as_py() * CHUNK, q)
                merged = [_merged(found[s] if found else None, part, k) for s, part in enumerate(new)]
                held[key] = (q, merged, queries, low, high, labels)
        for entry in held.values():
            yield rows(*entry[:2])

    return run


def _search(chunks: DataFrame, keys: Keys, queries: DataFrame, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """The ``k`` best rows per anchor and window: q, slot, rank, score, vec_id, place, written.

    ``queries``: q, label, vector, norm and windows, an array of (low, high) of scores.
    """
    spark = queries.sparkSession
    square, slack = keys.square, keys.slack
    vec_id = chunks.schema["ids"].dataType.elementType.simpleString()

    def away(score: Column) -> Column:
        return F.sqrt(F.greatest(F.col("norm") + square - 2.0 * score, F.lit(0.0)))

    reach = F.sqrt("norm") + math.sqrt(square) + slack
    nearest = F.array_min(F.transform("windows", lambda w: F.when(w["high"] < FAR, away(w["high"].cast("double"))).otherwise(0.0)))
    farthest = F.array_max(F.transform("windows", lambda w: F.when(w["high"] < FAR, away(w["high"].cast("double"))).otherwise(0.0)))
    active = queries.withColumns({"nearest": nearest, "done": F.lit(-1.0) - 2 * slack, "wide": farthest})
    packs = queries.count() // PACK + 1
    cells = spark.createDataFrame([(n, *row[:2], row[4] // SLICE + 1) for n, row in enumerate(keys.directory)], "at int, pivot int, cell int, slices long")
    sized = chunks.join(F.broadcast(cells), ["pivot", "cell"]).withColumn("slice", F.pmod(F.xxhash64("chunk"), "slices"))
    on = ["at", "slice", *(["label"] if same else [])]
    best = None
    while True:
        asked = active.select("q", "vector", "norm", "nearest", "done", "wide").mapInArrow(releasing(_asked(keys)), "q long, cells array<int>")
        wanted = asked.select("q", F.explode("cells").alias("at")).join(active.select("q", "label", "vector", "windows"), "q")
        salt = F.pmod(F.xxhash64("q"), F.lit(packs)).alias("salt")
        packed = wanted.groupBy("at", salt, *(["label"] if same else [])).agg(F.collect_list(F.struct("q", "label", "vector", "windows")).alias("pack"))
        sliced = packed.join(F.broadcast(cells.select("at", "slices")), "at").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        met = sliced.select(*on, "pack").join(sized.select("at", "slice", "label", "chunk", "ids", "vectors"), on)
        pairs = met.select("pack", "label", "chunk", "ids", "vectors")
        found = pairs.mapInArrow(releasing(_scored(keys.dims, k, same)), f"q long, slot int, score long, vec_id {vec_id}, place long")
        if best is not None:
            found = found.unionByName(best.select("q", "slot", "score", "vec_id", "place"))
        order = Window.partitionBy("q", "slot").orderBy(F.desc("score"), "vec_id", "place")
        best = scratch.written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best", BATCH)
        worst = best.groupBy("q", "slot").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        slots = active.select("*", F.posexplode("windows").alias("slot", "window")).join(worst, ["q", "slot"], "left")
        open_end = F.least(away(F.col("window.low").cast("double")), 4 * F.greatest("wide", F.lit(math.sqrt(square) / 4)))
        need = F.when(F.coalesce("n", F.lit(0)) >= k, away(F.col("worst").cast("double"))).otherwise(open_end)
        needs = slots.groupBy("q").agg(F.max(F.least(need, reach)).alias("need"))
        after = active.join(needs, "q").filter(F.col("need") > F.col("wide")).select(*queries.columns, "nearest", F.col("wide").alias("done"), F.col("need").alias("wide"))
        active = scratch.written(after, "active")
        if active.isEmpty():
            return best


def mine(
    embeddings: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: tuple[int, int] = PERCENT
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings`` has vec_id, label (a whole number) and embedding. Rows with a null id, label or vector,
    or a null or non-finite component, take no part. Anchors are the rows whose id ``every`` divides. A score
    is the inner product of ``floor(256 * x)``; higher ones come first, then smaller ids, then places in the
    keys. Vectors of different lengths are compared on their common components; an empty one scores zero.
    An anchor's positives are its first ``positives`` other rows of the same label. Per anchor and positive
    the first ``negatives`` rows of other labels are returned whose score is between ``percent`` of the
    positive's; a positive with a negative score has none. Repeated rows are rows of their own: each is an
    anchor, and each a positive or negative of others. An empty table gives no rows; further columns are
    ignored. Components for which inner products exceed 2^52 raise an error.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    kind = rows.schema["vec_id"].dataType.simpleString()
    result = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    low, high = percent
    with Scratch(spark) as scratch:
        stored = _store(rows, scratch)
        if stored is None:
            return spark.createDataFrame([], result)
        chunks, keys = stored
        label = rows.schema["label"].dataType.simpleString()
        found = chunks.select("label", "chunk", "ids", "vectors").mapInArrow(
            releasing(_anchors(every, keys.dims)), f"q long, anchor_id {kind}, label {label}, vector binary, norm double"
        )
        anchors = scratch.written(found, "anchors", BATCH)
        whole_range = F.array(F.struct(F.lit(-FAR).alias("low"), F.lit(FAR).alias("high")))
        own = _search(chunks, keys, anchors.select("q", "label", "vector", "norm", whole_range.alias("windows")), positives, True, scratch)
        usable = own.filter("score >= 0")
        bounds = F.struct("rank", F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high"))
        windows = F.transform(F.array_sort(F.collect_list(bounds)), lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high")))
        queries = anchors.join(usable.groupBy("q").agg(windows.alias("windows")), "q").select("q", "label", "vector", "norm", "windows")
        best = _search(chunks, keys, scratch.written(queries, "queries"), negatives, False, scratch)
        # Scores fall with the rank, so that the usable positives are the first ones and a window's slot is its rank less one.
        pairs = usable.select("q", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        mined = best.join(pairs, ["q", "slot"]).join(anchors.select("q", "anchor_id"), "q")
        return written(
            mined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"
        )
