"""Line dedup as an exact set-similarity join (native DataFrame functions only).

A line is the set of its words. Two lines match if their sets' Jaccard similarity is at least
``SIMILARITY``; a line goes if an earlier line matches it. Earlier is by doc_id, then line number.

* A text is split and its words are hashed once; what follows reads the written hashes.
* Lines with equal sets are one class; only classes are joined.
* Each class orders its words by rarity. Of classes that match, the smaller one has one of its first
  words among the first of the larger one (prefix filter; the smaller one's prefix is the shorter).
  The words' places and the classes' sizes bound the overlap (positional and length filters), and the
  parities of the words' hashes bound the difference. The join tests all of this itself, so that what
  leaves it is hardly more than the matching pairs.
* Survivors are verified on the words of both lines.

Groups of many variants of one line would still give every pair of the group. Therefore each class
is first held against a few earlier ones of three families: those with the same smallest and largest
word hash, once for the hashes as they are and once for other ones, and those with the same last two
words of the prefix, since the words in which variants differ are mostly rarer. The nearest one of
each family is a likely match, which is verified at once; a class with one that holds is no later side of
the join. Sets of more than 64 words have two
parities, as one says little of them: pairs that share no more than a word would be candidates.

A word's place in the order and 52 bits of its XXH64 hash are one integer. Sets count as equal if a
64-bit hash of these integers and the 64-bit parity agree.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenfold.llm import sets
from tokenfold.llm.common import Scratch, written

#: Similarity from which a later line goes, as numerator and denominator.
SIMILARITY = (4, 5)

#: Lines with fewer distinct words stay.
MIN_WORDS = 5

#: As ``min_words``: every line that isn't blank is compared.
NON_BLANK = 1

#: Earlier classes of a family with which a class is compared: those so many places before.
BEFORE = (1, 2, 3, 5, 8)

#: A family is dealt to one more part for each so many lines of the corpus.
PART_LINES = 2_000_000

#: Entries of families that are sorted together on average; most families have one member, too few for a window of their own.
BUCKET_ROWS = 100

#: Classes with more than one of so many lines are joined to the lines by broadcast; they are fewer than this.
HOT_SHARE = 1000

#: Sets of more words have a second parity, of half of their words; 64 bits say little of them.
LARGE = 64

#: Turns word hashes into other ones, whose smallest and largest are other words.
OTHER_HASHES = 0x5A5A5A5A5A5A5

PLACE = ["doc_id", "line_no", "mark"]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark and line_no of every line, with the line; mark tells texts of one id apart."""
    split = docs.select("doc_id", F.xxhash64(_text()).alias("mark"), F.split(_text(), "\n", -1).alias("lines"))
    return split.select("doc_id", "mark", F.posexplode("lines").alias("line_no", "line"))


def _words(line: Column) -> Column:
    """A line's words in lower case, empty ones among them; words end at spaces, tabs and carriage returns."""
    spaced = F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.split(F.lower(spaced), " ")


def _least_joined(similarity: tuple[int, int], min_words: int) -> int:
    """Words of the smallest sets that can match other sets than equal ones: with one word less than those."""
    top, bottom = similarity
    return max(min_words, -(-top // (bottom - top))) if top < bottom else min_words


def _hashed(docs: DataFrame, min_words: int) -> DataFrame:
    """Per line with enough words: its place, and ``words``, the hashes of its distinct words."""
    hashes = F.array_distinct(F.transform(_words(F.col("line")), sets.hashed))
    distinct = _lines(docs).select(*PLACE, F.array_remove(hashes, sets.hashed(F.lit(""))).alias("words"))
    # As a row of an exploded array, a set is not made anew for a filter that is pushed below it.
    chosen = F.when(F.size("words") >= min_words, F.array("words"))
    return distinct.select(*PLACE, F.explode(chosen).alias("words"))


def _one_bit(key: Column) -> Column:
    """A long with one bit set; of an int, a shift counts the last six bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(key))


def _parity(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda held, k: held.bitwiseXOR(_one_bit(k)))


def _described(hashed: DataFrame, similarity: tuple[int, int], min_words: int, counters: int) -> DataFrame:
    """Per line of the written ``hashed``: its place, n, cls and parity of its set, its prefix, and two hashes of its extreme word hashes.

    ``prefix`` leaves out the leading words that no other line has; ``skipped`` counts them. Sets so
    small that only equal ones match have no prefix. A word is counted once a line.
    """
    levels = sets.levels(hashed.select(F.explode("words").alias("value")), counters)
    other = F.transform("words", lambda w: w.bitwiseXOR(F.lit(OTHER_HASHES)))
    # The analyzer takes no scalar inside a lambda; the optimizer puts it there, as one use is left.
    held = hashed.withColumn("levels", levels)
    keys = F.sort_array(F.transform("words", lambda w: sets.key(F.col("levels"), w, counters)))
    keyed = held.select(*PLACE, "words", other.alias("other"), keys.alias("keys"))
    n = F.size("keys")
    half = F.when(n > LARGE, _parity(F.filter("keys", lambda k: k.bitwiseAND(F.lit(1 << 17)) > 0)))
    least = _least_joined(similarity, min_words)
    length = F.when(n >= least, sets.prefix(n, similarity)).otherwise(0).cast("int")
    ends, others = (F.xxhash64(F.array_min(c), F.array_max(c)).alias(name) for c, name in (("words", "ends"), ("other", "others")))
    sliced = F.slice("keys", F.lit(1), length).alias("head")
    first = keyed.select(*PLACE, n.alias("n"), ends, others, half.alias("half"), F.xxhash64("keys").alias("cls"), _parity(F.col("keys")).alias("parity"), sliced)
    alone = F.lit((60 + 1) << sets.HASH_BITS)  # the level of a count of one is 60
    kept = F.filter("head", lambda k: k >= alone)
    return first.withColumn("prefix", kept).withColumn("skipped", F.size("head") - F.size("prefix")).drop("head")


def _differing(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """In how many bits the parities differ; if both sets are large, those of half of their words and those of the others."""
    whole, half = (a(c).bitwiseXOR(b(c)) for c in ("parity", "half"))
    return F.coalesce(F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half)), F.bit_count(whole))


def _near(a: Callable[[str], Column], b: Callable[[str], Column], similarity: tuple[int, int]) -> Column:
    """Sizes and parities (n, parity, half) differ by no more than those of matching sets."""
    top, bottom = similarity
    return (
        (bottom * a("n") >= top * b("n"))
        & (bottom * b("n") >= top * a("n"))
        & ((bottom + top) * _differing(a, b) <= (bottom - top) * (a("n") + b("n")))
    )


def _classes(described: DataFrame, scratch: Scratch) -> DataFrame:
    """Per class: cls, parity, half, n, ends, others, skipped, prefix, ``first`` (the place of its first line), copies, and a number ``id``."""
    same = [F.first(c).alias(c) for c in ("n", "ends", "others", "half", "skipped", "prefix")]
    grouped = described.groupBy("cls", "parity").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"), *same)
    return scratch.written(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")


def _sure(docs: DataFrame, classes: DataFrame, lines: int, similarity: tuple[int, int], scratch: Scratch) -> DataFrame:
    """cls and parity of the classes of which a likely match holds.

    Likely matches are earlier classes that pass the filters: of a few of each family, the nearest. The
    families are dealt without the prefixes, and few classes have a likely match, so little is shuffled.
    """
    last = F.xxhash64(*[F.get("prefix", F.size("prefix") - k) for k in (1, 2)])
    # Sets without a prefix match equal ones only.
    some = classes.filter("size(prefix) > 0").withColumn("part", F.pmod("cls", F.lit(1 + lines // PART_LINES)))
    thin = some.select("cls", "first", "parity", "half", "n", "part", F.posexplode(F.array("ends", "others", last)).alias("family", "key"))
    keyed = thin.withColumn("key", F.xxhash64("family", "key", "part")).drop("family", "part")
    dealt = keyed.withColumn("bucket", F.pmod("key", F.lit(1 + 3 * lines // BUCKET_ROWS)))
    order = Window.partitionBy("bucket").orderBy("key", "first")
    beside = dealt.withColumns({"back": F.lag("key").over(order), "ahead": F.lead("key").over(order)})
    shared = beside.filter((F.col("back") == F.col("key")) | (F.col("ahead") == F.col("key"))).drop("back", "ahead")
    own = F.struct("key", "first", "parity", "half", "n")
    earlier = {f"e{k}": F.lag(own, k).over(order) for k in BEFORE}
    met = []
    for e in earlier:
        other = functools.partial(lambda e, c: F.col(f"{e}.{c}"), e)
        near = (other("key") == F.col("key")) & (other("first") < F.col("first")) & _near(F.col, other, similarity)
        met.append(F.when(near, F.struct(_differing(F.col, other).alias("differing"), other("first"))))
    found = shared.withColumns(earlier).select(F.least(*met)["first"].alias("first_a"), F.col("first").alias("first_b"), "cls", "parity")
    likely = scratch.written(found.filter("first_a IS NOT NULL").distinct(), "likely")
    return scratch.written(_verified(docs, likely, similarity), "sure")


def _joined(classes: DataFrame, sure: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of classes that pass the filters, of which the later one, b, is open, which is not ``sure``: first_a, first_b, cls and parity of b.

    Words meet by 32 bits, and an entry holds n, pos and open in one number, as these rows are most of what is shuffled.
    """
    top, bottom = similarity
    settled = sure.withColumn("open", F.lit(False))
    some = classes.filter("size(prefix) > 0").join(settled, ["cls", "parity"], "left").withColumn("open", F.col("open").isNull())
    words = some.select("id", "parity", "half", "n", "skipped", "open", "first.doc_id", F.posexplode("prefix").alias("i", "word"))
    pos = F.col("i") + F.col("skipped")
    shape = (F.col("n").cast("long") * (1 << 32)) + 2 * pos + F.col("open").cast("int")
    columns = ["parity", "half", shape.alias("shape"), "doc_id", "id"]
    entries = words.select(F.hash("word").alias("key"), *columns)
    x, y = (entries.select("key", *[F.col(c).alias(f"{side}_{c}") for c in entries.columns[1:]]) for side in "xy")

    def of(side: str) -> dict[str, Column]:
        held = F.col(f"{side}_shape")
        low = held.bitwiseAND(F.lit((1 << 32) - 1))
        return {"n": F.shiftright(held, 32), "pos": F.shiftright(low, 1), "open": low.bitwiseAND(F.lit(1)) == 1, "parity": F.col(f"{side}_parity"), "half": F.col(f"{side}_half")}

    own_x, own_y = of("x"), of("y")
    left = F.least(own_x["n"] - own_x["pos"], own_y["n"] - own_y["pos"])
    smaller = (own_x["n"] < own_y["n"]) | ((own_x["n"] == own_y["n"]) & (F.col("x_id") < F.col("y_id")))
    # The smaller one's prefix is short. As a test of both sides, this is made in the join, and one shuffle serves both.
    early = own_x["pos"] < sets.short_prefix(F.least(own_x["n"], own_y["n"]), similarity)
    # Within one document, or without ids, either may be the later.
    later_open = (
        F.when(F.col("x_doc_id") < F.col("y_doc_id"), own_y["open"])
        .when(F.col("y_doc_id") < F.col("x_doc_id"), own_x["open"])
        .otherwise(own_x["open"] | own_y["open"])
    )
    enough = (top + bottom) * left >= top * (own_x["n"] + own_y["n"])
    met = y.join(x, "key").filter(smaller & early & _near(own_x.get, own_y.get, similarity) & enough & later_open)
    pairs = met.select(F.struct("x_id", "y_id").alias("pair")).distinct()
    ends = pairs.select("pair", F.explode(F.array("pair.x_id", "pair.y_id")).alias("id"))
    named = ends.join(classes.select("id", F.struct("first", "cls", "parity").alias("end")), "id")
    both = named.groupBy("pair").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    a, b = (F.get("ends", F.lit(i)) for i in range(2))
    named = both.select(a["first"].alias("first_a"), b["first"].alias("first_b"), b["cls"].alias("cls"), b["parity"].alias("parity"))
    return named.join(sure, ["cls", "parity"], "left_anti")


def _verified(docs: DataFrame, pairs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Of written ``pairs`` (first_a, first_b: places of lines; cls, parity) the cls and parity of those whose lines match."""
    top, bottom = similarity
    keyed = pairs.select(F.struct("first_a", "first_b", "cls", "parity").alias("pair"))
    ends = keyed.select("pair", F.explode(F.array("pair.first_a", "pair.first_b")).alias("place"))
    sides = ends.select("pair", *[F.col(f"place.{c}").alias(f"own_{c}") for c in PLACE])
    own = [F.col(f"own_{c}") for c in PLACE]
    marks = sides.select(F.explode(F.array(F.xxhash64(own[0], own[2]), F.xxhash64(*own))).alias("value"))
    flags = sets.flags(marks)
    some = _lines(docs.filter(sets.flagged(flags, F.xxhash64("doc_id", F.xxhash64(_text())))))
    found = some.filter(sets.flagged(flags, F.xxhash64(*PLACE))).groupBy(*PLACE).agg(F.first("line").alias("line"))
    met = sides.join(found, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in PLACE])
    both = met.groupBy("pair").agg(F.collect_list("line").alias("lines")).filter(F.size("lines") == 2)
    a, b = (F.array_remove(_words(F.get("lines", F.lit(i))), "").alias(c) for i, c in enumerate("ab"))
    # As a lambda's argument, the words are split once only.
    alike = F.exists(F.array(F.struct(a, b)), lambda x: bottom * F.size(F.array_intersect(x["a"], x["b"])) >= top * F.size(F.array_union(x["a"], x["b"])))
    return both.filter(alike).select("pair.cls", "pair.parity").distinct()


def removed_lines(
    docs: DataFrame,
    similarity: tuple[int, int] = SIMILARITY,
    min_words: int = MIN_WORDS,
    counters: int = sets.COUNTERS,
) -> DataFrame:
    """Per text with a line to remove: doc_id, mark (a hash of the text) and ``removed``, the line numbers.

    Lines of fewer than ``min_words`` distinct words stay, empty ones among them. Rows with the
    same id and text are one text, of which no copy is earlier; rows of one id with other texts are
    ordered by the hash of the text. Null ids come first. Null texts have one empty line.
    """
    place = F.struct(*PLACE)
    with Scratch(docs.sparkSession) as scratch:
        with Scratch(docs.sparkSession) as own:
            with Scratch(docs.sparkSession) as early:
                hashed = early.written(_hashed(docs, min_words), "hashed")
                described = own.written(_described(hashed, similarity, min_words, counters), "described")
            classes = _classes(described, scratch)
            lines = scratch.written(described.select(*PLACE, "cls", "parity"), "lines")
        many = lines.count()
        sure = _sure(docs, classes, many, similarity, scratch)
        pairs = scratch.written(_joined(classes, sure, similarity), "pairs")
        settled = sure.unionByName(_verified(docs, pairs, similarity))
        repeated = classes.filter("copies > 1").select("cls", "parity", "first", "copies")
        nothing = [F.lit(None).cast(repeated.schema[c].dataType).alias(c) for c in ("first", "copies")]
        merged = repeated.unionByName(settled.select("cls", "parity", *nothing)).groupBy("cls", "parity")
        gone = F.max(F.col("copies").isNull()).alias("gone")
        state = scratch.written(merged.agg(gone, F.max("first").alias("first"), F.max("copies").alias("copies")), "state")
        # A line with very many copies is no hot key of a shuffle.
        hot = F.coalesce(F.col("copies") > many / HOT_SHARE, F.lit(False))
        few = F.broadcast(state.filter(hot).select("cls", "parity", F.struct("gone", "first").alias("hot")))
        met = lines.join(few, ["cls", "parity"], "left")
        rest = met.filter("hot IS NULL").drop("hot").join(state.filter(~hot), ["cls", "parity"])
        judged = met.filter("hot IS NOT NULL").select(*PLACE, "hot.gone", "hot.first").unionByName(rest.select(*PLACE, "gone", "first"))
        out = judged.filter(F.col("gone") | (place != F.col("first")))
        return written(out.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "removed")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with later matching lines taken out of ``text``.

    Every row stays, with all its columns, whatever their names; a text of which every line goes
    becomes empty. A null text stays null.
    """
    found = removed_lines(docs, **options)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(_text()).alias("own_mark"))
    met = own.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own_mark") == F.col("mark")), "left")
    lines = F.split("row.text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left)
    return met.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def summary(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, its lines, how many go, and their numbers in order."""
    found = removed_lines(docs, **options).withColumnsRenamed({"doc_id": "found_id", "mark": "found_mark"})
    own = docs.select("doc_id", F.xxhash64(_text()).alias("mark"), (F.octet_length(_text()) - F.octet_length(F.replace(_text(), F.lit("\n"))) + 1).cast("long").alias("n_lines"))
    both = own.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark")), "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return both.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))
