"""SimHash near-duplicates: a binary trie of the fingerprints joined with itself.

The trie's levels are segments of the fingerprint's bits. Pairs of nodes are traversed together:
a pair carries the bits in which its nodes differ so far, and goes when they exceed the budget.
A walk from one root would meet every pair of shallow nodes. So the trie is built once for each
choice of levels that may come first with no differing bit: with budget k and k + 2 segments, two
fingerprints within the budget agree in two segments at least, so the trie that has these on top
joins a node there with itself alone. Every pair is found, and the pairs follow the linked ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenfold.llm import sets
from tokenfold.llm.common import SPACE_CLASS, Scratch, releasing, written

SHINGLE = 3
BUDGET = 2
BITS = 64

#: Of near copies: words of a shingle, and the Jaccard similarity of the shingle sets as numerator and denominator.
COPY_SHINGLE, SIMILARITY = 5, (4, 5)

#: Min-hashes by which texts become candidates: bands, and rows of a band. A pair at 0.8 shares a
#: band with a chance of 1 - (1 - 0.8^5)^24, over 0.9999.
BANDS, ROWS = 24, 5

#: With which earlier texts of a band's bucket a text is compared at first: the first one, and those so many places before.
BEFORE = (1, 2, 3)

#: Longs of a text's parities, by which most texts that share a shingle only are told apart.
PARITIES = 8


def _words(text: Column) -> Column:
    """The words of a text with A to Z lower-cased."""
    folded = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(folded, f"{SPACE_CLASS}+"), "")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Majority bits of each row's hashes, a bit at a time over the whole batch."""
    import numpy as np

    for batch in batches:
        hashes = batch.column(1)
        sizes = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        prints = np.zeros(len(sizes), np.uint64)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            for bit in range(BITS):
                ones = np.add.reduceat(((flat >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
                prints[some] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(bit)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _shingles(size: int) -> Column:
    """The hashes of the shingles of the column ``words``; null without words."""
    n = F.size("words")
    return F.when(
        n >= size,
        F.transform(
            F.sequence(F.lit(0), n - size),
            lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(size)])),
        ),
    ).when(n > 0, F.array(F.xxhash64(F.array_join("words", " "))))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per document row: doc_id and fp, its fingerprint as a signed 64-bit integer.

    A bit is set if over half of the text's shingles have it in their hash. Fewer words than a
    shingle are one shingle; null, empty and wordless texts have fingerprint 0.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", _words(F.col("text").cast("string")).alias("words")).select("doc_id", _shingles(size).alias("hashes"))
    return hashed.mapInArrow(releasing(_fingerprints), f"doc_id {id_type}, fp long")


def _segments(budget: int) -> list[tuple[int, int]]:
    """Shift and width of budget + 2 segments of the fingerprint."""
    count = budget + 2
    edges = [BITS * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def linked(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Pairs (a, b), a < b, of the ids in ``prints`` (rep, fp; fp distinct) within ``budget`` differing bits."""
    segments = _segments(budget)

    def bits(k: int) -> Column:
        shift, width = segments[k]
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))

    tries = []
    for t, top in enumerate(combinations(range(len(segments)), 2)):
        rest = [k for k in range(len(segments)) if k not in top]
        tail = F.lit(0).cast("long")
        for k in rest[1:]:
            tail = F.shiftleft(tail, segments[k][1]).bitwiseOR(bits(k))
        tries.append(
            F.struct(
                F.lit(t).alias("trie"),
                F.shiftleft(bits(top[0]), segments[top[1]][1]).bitwiseOR(bits(top[1])).alias("head"),
                bits(rest[0]).alias("mid"),
                tail.alias("tail"),
            )
        )
    leaves = prints.select("rep", F.inline(F.array(*tries)))
    node = ["trie", "head"]
    nodes = leaves.groupBy(*node, "mid").agg(F.count("*").alias("leaves"))
    a, b = nodes.alias("a"), nodes.alias("b")
    differing = F.bit_count(F.col("a.mid").bitwiseXOR(F.col("b.mid")))
    pairs = a.join(
        b,
        (F.col("a.trie") == F.col("b.trie"))
        & (F.col("a.head") == F.col("b.head"))
        & ((F.col("a.mid") < F.col("b.mid")) | ((F.col("a.mid") == F.col("b.mid")) & (F.col("a.leaves") > 1)))
        & (differing <= budget),
    ).select("a.trie", "a.head", F.col("a.mid").alias("mid_a"), F.col("b.mid").alias("mid_b"), differing.alias("spent"))
    first = leaves.select(*node, F.col("mid").alias("mid_a"), F.col("tail").alias("tail_a"), F.col("rep").alias("rep_a"))
    second = leaves.select(*node, F.col("mid").alias("mid_b"), F.col("tail").alias("tail_b"), F.col("rep").alias("rep_b"))
    met = (
        pairs.join(first, [*node, "mid_a"])
        .join(second, [*node, "mid_b"])
        .filter(F.col("spent") + F.bit_count(F.col("tail_a").bitwiseXOR(F.col("tail_b"))) <= budget)
        .filter((F.col("mid_a") < F.col("mid_b")) | (F.col("rep_a") < F.col("rep_b")))
    )
    ends = met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    return ends.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Large-star and small-star steps in turn until nothing changes; each round is a written table,
    and only its size and a checksum come to the driver.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    held = written(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), "edges")
    seen = state(held)
    while seen[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = state(held)
        if now == seen:
            break
        seen = now
    star = held.groupBy("u").agg(F.min("v").alias("component"))
    roots = held.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return star.select(F.col("u").alias("node"), "component").unionByName(roots)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per document row: doc_id, fp and component_id, the smallest doc_id of its group.

    Fingerprints link at up to ``budget`` differing bits; groups are their connected components,
    so rows with equal fingerprints (repeated rows and all wordless texts among them) share one.
    Rows without doc_id get the component of their fingerprint, null if no row with an id has it.
    An empty table gives no rows. Further columns are ignored.

    Only distinct fingerprints, each with its smallest doc_id, are joined; a group of any number of
    equal ones is one row there.
    """
    prints = written(fingerprints(docs, size), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(linked(classes.filter("rep IS NOT NULL"), budget))
    named = classes.join(found, classes.rep == found.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key per band of each row's shingle hashes; rows without any are left out."""
    import numpy as np

    draw = np.random.default_rng(7)
    odd, mask = (draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
    odd = 2 * odd + np.uint64(1)
    mix = 2 * draw.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) + np.uint64(1)
    for batch in batches:
        # Left out here, as a filter in the plan would be pushed below the shingles and make them anew.
        batch, keys = batch.filter(batch.column(1).is_valid()), []
        for row in batch.column(1):
            own = row.values.to_numpy(zero_copy_only=False).view(np.uint64)
            least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
            for k in range(0, len(own), 4096):
                least = np.minimum(least, ((own[k : k + 4096] ^ mask) * odd).min(1))
            keys.append((least.reshape(BANDS, ROWS) * mix).sum(1, dtype=np.uint64).view(np.int64))
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, flat)], ["node", "keys"])


def _similar(texts: DataFrame, pairs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Of written ``pairs`` (a, b: nodes of ``texts``) those whose shingle sets match; sets without shingles match each other."""
    top, bottom = similarity
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = F.coalesce(_shingles(size), F.array().cast("array<bigint>"))
    sets = texts.join(needed, "node").select("node", _words(F.col("text")).alias("words")).select("node", F.array_distinct(own).alias("set"))
    a, b = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(a, "a").join(b, "b").filter(bottom * shared >= top * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _prefixes(texts: DataFrame, size: int, similarity: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Per text of ``texts`` (mark, text): mark, n, parities, and its rarest shingles (prefix), written for the block of ``scratch``.

    The whole sets, which take the most disk, are gone when this returns.
    """
    own = F.coalesce(_shingles(size), F.array().cast("array<bigint>"))
    words = texts.select("mark", _words(F.col("text")).alias("words"))
    masked = F.array_distinct(F.transform(own, lambda h: h.bitwiseAND(F.lit((1 << sets.HASH_BITS) - 1))))
    with Scratch(texts.sparkSession) as own_scratch:
        # Written, as a filter of an explode would be pushed below the shingles and split a text for each of them.
        shingled = own_scratch.written(words.select("mark", masked.alias("items")), "shingles")
        levels = sets.levels(shingled.select(F.explode("items").alias("value")), sets.COUNTERS)
        held = shingled.withColumn("levels", levels)
        keyed = held.select(
            "mark", F.sort_array(F.transform("items", lambda x: sets.key(F.col("levels"), x, sets.COUNTERS))).alias("keys")
        )
        length = sets.prefix(F.size("keys"), similarity).cast("int")
        first = keyed.select("mark", F.size("keys").alias("n"), sets.parities(F.col("keys"), PARITIES).alias("parities"), F.slice("keys", F.lit(1), length).alias("prefix"))
        return scratch.written(first, "prefixes")


def _across(rows: DataFrame, grouped: DataFrame, similarity: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of marks of different groups whose texts may match: every pair that does is among them.

    A prefix join of the written ``rows`` of ``_prefixes``, rare shingles first. ``grouped`` has mark and group. A shingle
    all of whose texts are of one group is left out, so that a group of copies gives no pairs. Such shingles are
    most of all; they are told by key and group alone, and only the others' entries are shuffled and get sizes and parities.
    """
    top, bottom = similarity
    placed = rows.select("mark", F.posexplode("prefix").alias("pos", "key"))
    dealt = rows.select("mark", "prefix").join(grouped, "mark").select("group", F.explode("prefix").alias("key"))
    spans = dealt.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    mixed = scratch.written(spans.filter("low <> high").select("key"), "mixed")
    flags = sets.flags(mixed.select(F.col("key").alias("value")))
    met = placed.filter(sets.flagged(flags, F.col("key"))).join(mixed, "key")
    shapes = rows.select("mark", "n", "parities").join(grouped, "mark")
    some = scratch.written(met.join(shapes, "mark").select("key", "mark", "group", "n", "parities", "pos"), "entries")
    y = some.select("key", *[F.col(c).alias(f"y_{c}") for c in some.columns[1:]])
    x = some.filter(F.col("pos") < sets.short_prefix(F.col("n"), similarity)).select("key", *[F.col(c).alias(f"x_{c}") for c in some.columns[1:]])
    smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_mark") < F.col("y_mark")))
    both = F.col("x_n") + F.col("y_n")
    left = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    near = y.join(x, "key").filter(
        (F.col("x_group") != F.col("y_group"))
        & smaller
        & (bottom * F.col("x_n") >= top * F.col("y_n"))
        & ((top + bottom) * left >= top * both)
        & ((top + bottom) * sets.differing(F.col("x_parities"), F.col("y_parities"), PARITIES) <= (bottom - top) * both)
    )
    return near.select(F.least("x_mark", "y_mark").alias("a"), F.greatest("x_mark", "y_mark").alias("b")).distinct()


def near_copies(docs: DataFrame, size: int = COPY_SHINGLE, similarity: tuple[int, int] = SIMILARITY, budget: int = BUDGET) -> DataFrame:
    """(doc_id, mark, component) per different text and id: mark is the text's hash, component the smallest (doc_id, mark) of its group.

    Texts link if the Jaccard similarity of their shingle sets is at least ``similarity``. Likely pairs
    come first: fingerprints within ``budget`` differing bits, and texts that share a band of min-hashes;
    of a bucket of many texts each meets a few earlier ones. An exact join then finds every link between
    texts that these left in different groups, so none is lost. Every link is verified on the whole sets.
    Rows without doc_id are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    own = F.struct("doc_id", "mark")
    places = written(rows.select("doc_id", "mark").distinct(), "places")
    with Scratch(docs.sparkSession) as scratch:
        texts = scratch.written(rows.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")).select(own.alias("node"), "text"), "texts")
        prints = scratch.written(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), size).select(F.col("doc_id").alias("node"), "fp"), "fingerprints")
        classes = scratch.written(prints.groupBy("fp").agg(F.min("node").alias("rep")), "classes")
        equal = prints.join(classes, "fp").filter("node > rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
        hashed = texts.select("node", _words(F.col("text")).alias("words")).select("node", _shingles(size).alias("hashes"))
        node_type = texts.schema["node"].dataType.simpleString()
        entries = hashed.mapInArrow(releasing(_bands), f"node {node_type}, keys array<bigint>").select("node", F.posexplode("keys").alias("band", "key"))
        order = Window.partitionBy("band", "key").orderBy("node")
        first = F.first_value("node").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        met = entries.select("node", F.array(first, *[F.lag("node", k).over(order) for k in BEFORE]).alias("earlier"))
        banded = met.select(F.explode("earlier").alias("a"), F.col("node").alias("b")).filter("a < b")
        pairs = scratch.written(linked(classes, budget).unionByName(equal).unionByName(banded).distinct(), "pairs")
        found = components(_similar(texts, pairs, size, similarity))
        grouped = written(texts.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "grouped")
        marked = texts.select(F.col("node.mark").alias("mark"), "text")
        of_mark = grouped.select(F.col("node.mark").alias("mark"), F.xxhash64("component").alias("group"))
        rest = scratch.written(_across(_prefixes(marked, size, similarity, scratch), of_mark, similarity, scratch), "rest")
        named = grouped.select(F.col("node.mark").alias("mark"), "component")
        if not rest.isEmpty():
            a, b = (named.select(F.col("mark").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
            links = _similar(marked.withColumnRenamed("mark", "node"), rest, size, similarity).join(a, "a").join(b, "b")
            merged = components(links.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct())
            joined = named.join(merged.select(F.col("node").alias("component"), F.col("component").alias("merged")), "component", "left")
            named = joined.select("mark", F.coalesce("merged", "component").alias("component"))
    return places.join(named, "mark").select("doc_id", "mark", "component")
