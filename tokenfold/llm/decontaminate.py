"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised to words; every window of an item is a key of the automaton, whose letters
are word numbers, so a match always starts and ends between words. Each text is scanned once;
matches are merged into word ranges and mapped back to byte offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.llm.common import releasing, written

#: Words in a window.
WINDOW = 10

#: Windows in one automaton (about 100 bytes a word of a window); more are scanned in more passes.
WINDOWS_PER_PASS = 200_000


def _fold_table() -> bytes:
    """ASCII letters lower-cased, digits and all bytes from 0x80 kept, the rest a space."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in range(128):
        c = chr(b)
        if c.isalnum():
            out[b] = ord(c.lower())
    return bytes(out)


FOLD = _fold_table()


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, windows = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (text.as_py() or b"").translate(FOLD).split()
            found = {b" ".join(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))} if words else ()
            items += [item] * len(found)
            windows += found
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(items, pa.string())], ["window", "item"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows of the benchmark with the ids of their items (null ids: none)."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    rows = items.mapInArrow(releasing(_item_windows), "window binary, item string")
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def _scan(windows: list[tuple[bytes, list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import numpy as np

        numbers: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows:
            key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in window.split(b" "))
            automaton.add_word(key, (len(key), items))
        automaton.make_automaton()
        number = numbers.get
        schema = pa.schema([("n_words", pa.int64()), ("ranges", pa.list_(pa.int64())), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        for batch in batches:
            text_at, before, had = (batch.schema.get_field_index(c) for c in ("text", "ranges", "items"))
            counts, ranges, spans, items = [], [], [], []
            for k in range(batch.num_rows):
                folded = (batch.column(text_at)[k].as_py() or b"").translate(FOLD)
                words = folded.split()
                counts.append(len(words))
                held = batch.column(before)[k].as_py() or []
                hits = [[held[i], held[i + 1]] for i in range(0, len(held), 2)]
                which = set(batch.column(had)[k].as_py() or ())
                for end, (size, names) in automaton.iter(tuple(number(w, 0) for w in words)) if words else ():
                    hits.append([end + 1 - size, end + 1])
                    which.update(names)
                merged: list[list[int]] = []
                for a, b in sorted(hits):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                where: list[int] = []
                if merged:
                    letters = np.frombuffer(folded, np.uint8) != 32
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], letters, [False])).astype(np.int8)))
                    where = [int(x) for a, b in merged for x in (edges[2 * a], edges[2 * b - 1])]
                ranges.append([x for r in merged for x in r])
                spans.append(where)
                items.append(sorted(which))
            made = {"n_words": counts, "ranges": ranges, "spans": spans, "items": items}
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in made]
            names = [f.name for f in batch.schema if f.name not in made]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(made[f.name], f.type) for f in schema]], [*names, *schema.names])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, windows_per_pass: int = WINDOWS_PER_PASS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document row: the ``keep`` columns, text, n_words, hit word ranges and items.

    ``ranges`` holds start and end word of each merged hit, ``spans`` the same as byte offsets in
    the UTF-8 text as given, ``items`` the ids of items with an occurring window (as strings, each
    once). Null and wordless texts have no words and no hits; null item ids hit words but name no
    item; an empty benchmark hits nothing. Repeated rows are judged alike.

    Texts are never shuffled. An automaton is built from at most ``windows_per_pass`` windows,
    which is what the driver ever holds; a larger benchmark takes further passes over the texts.
    """
    windows = written(item_windows(benchmark), "windows")
    passes = max(1, -(-windows.count() // windows_per_pass))
    state = docs.select(
        *[F.col(c) for c in keep],
        F.col("text").cast("binary").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("ranges"),
        F.array().cast("array<long>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in state.schema])
    for k in range(passes):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(passes)) == k)
        held = [(bytes(r.window), list(r["items"])) for r in part.collect()]
        if held or not k:
            state = state.mapInArrow(releasing(_scan(held)), schema) if held else _uncounted(state, schema)
            state = written(state, "scanned") if k + 1 < passes else state
    return state.withColumn("text", F.col("text").cast("string"))


def _uncounted(state: DataFrame, schema: T.StructType) -> DataFrame:
    """Without any window only the words are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("n_words")
            texts = batch.column(batch.schema.get_field_index("text"))
            counts = pa.array([len((t.as_py() or b"").translate(FOLD).split()) for t in texts], pa.int64())
            yield batch.set_column(at, "n_words", counts)

    return state.mapInArrow(releasing(run), schema)


def verdicts(scanned: DataFrame) -> DataFrame:
    """Figures per document: words, hit words, items, and whether it is contaminated."""
    ranges = F.col("ranges")
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.size(ranges) - 2, F.lit(2)),
        F.lit(0).cast("long"),
        lambda total, i: total + F.get(ranges, i + 1) - F.get(ranges, i),
    )
    return scanned.withColumn("n_hit", F.when(F.size(ranges) > 0, n_hit).otherwise(F.lit(0).cast("long"))).select(
        *[c for c in scanned.columns if c != "text"],
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
