"""Token counts; huge documents are encoded in overlapping chunks and spliced.

A text up to ``chunk`` characters is encoded whole. A longer one is cut into overlapping chunks
that any task may encode. The chunks' counts are spliced where two neighbours resynchronise:

* The tokenizer's word pattern looks at most one character beyond a word, so in a chunk that
  starts at a true word boundary every boundary is true up to a margin before the chunk's end.
* From a true boundary on, a text is encoded like a text that starts there. A boundary that the
  chunk before proves and the chunk after has too is therefore where both agree for good.

If the overlap has no such common boundary, the document is cut again with a wider overlap; at
last the overlap spans the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenfold.llm.common import releasing, written
from tokenfold.llm.vocabulary import Vocabulary

CHUNK = 32_768
OVERLAP = 512
WIDEN = 8


def _count_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Vocabulary(path).counter()
        for batch in batches:
            counts = pa.array([count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, text in zip(batch.column(0), batch.column(1)):
                whole = text.as_py()
                starts = range(0, max(1, len(whole) - overlap), chunk)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([sha.as_py()] * len(some), pa.string()),
                            pa.array(some, pa.int64()),
                            pa.array([s == starts[-1] for s in some], pa.bool_()),
                            pa.array([whole[s:] if s == starts[-1] else whole[s : s + chunk + overlap] for s in some], pa.string()),
                        ],
                        ["sha", "start", "last", "part"],
                    )

    return run


_SUMMARY = "sha string, start long, last boolean, total long, head array<struct<at:long,n:long>>, tail array<struct<at:long,n:long>>"


def _encode_chunks(path: str, chunk: int, overlap: int):
    """Per chunk: its tokens, and the word boundaries in its overlaps with the tokens before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        tokenizer, margin = vocabulary.tokenizer, vocabulary.longest_special + 2
        mark = pa.struct([("at", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            shas, starts, lasts = (batch.column(i).to_pylist() for i in range(3))
            totals, heads, tails = [], [], []
            for start, part in zip(starts, batch.column(3)):
                text = part.as_py()
                found = tokenizer.encode(text, add_special_tokens=False)
                words, offsets = found.word_ids, found.offsets
                totals.append(len(words))
                edge = len(text) - margin
                head, tail = [], []
                for i in range(1, len(words)):
                    if words[i] != words[i - 1]:
                        at = offsets[i][0]
                        if at < overlap:
                            head.append({"at": start + at, "n": i})
                        if chunk <= at < edge:
                            tail.append({"at": start + at, "n": i})
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shas, pa.string()), pa.array(starts, pa.int64()), pa.array(lasts, pa.bool_()),
                    pa.array(totals, pa.int64()), pa.array(heads, pa.list_(mark)), pa.array(tails, pa.list_(mark)),
                ],
                ["sha", "start", "last", "total", "head", "tail"],
            )

    return run


def _splice(summaries: DataFrame) -> DataFrame:
    """(sha, n_tokens) per long text; n_tokens is null if two neighbours have no common boundary."""
    order = Window.partitionBy("sha").orderBy("start")
    pairs = summaries.withColumn("next", F.lead("head").over(order))
    common = F.array_intersect(F.transform("tail", lambda x: x["at"]), F.transform("next", lambda x: x["at"]))
    met = pairs.withColumn("meet", F.array_min(common))
    left = F.get(F.filter("tail", lambda x: x["at"] == F.col("meet")), F.lit(0))["n"]
    right = F.get(F.filter("next", lambda x: x["at"] == F.col("meet")), F.lit(0))["n"]
    own = F.when(F.col("last"), F.col("total")).otherwise(left - right)
    return (
        met.withColumn("own", own)
        .groupBy("sha")
        .agg(F.when(F.count("own") == F.count("*"), F.sum("own")).alias("n_tokens"))
    )


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document row: doc_id, n_bytes (UTF-8) and n_tokens of the whole text.

    Null and empty texts have 0 of both; repeated rows each get their count; further columns are
    ignored. ``path`` is a tokenizers JSON file; its special strings count as the library's
    default has it, and nothing is added, cut or padded.

    Only long texts are shuffled, each different one once, and its chunks are spread over tasks. A round of widening runs only while a splice fails.
    """
    if overlap > chunk:
        raise ValueError("the overlap may not exceed the chunk")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    short = sized.filter(F.char_length("text") <= chunk).mapInArrow(
        releasing(_count_whole(path)), f"doc_id {id_type}, n_bytes long, n_tokens long"
    )
    long = sized.filter(F.char_length("text") > chunk)
    keyed = long.select("doc_id", "n_bytes", F.sha2("text", 256).alias("sha"))
    # Copies of a text are merged, and their number leaves each task already as one.
    texts = written(long.groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text")), "long_texts")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted: DataFrame | None = None
    left = texts
    while True:
        parts = left.mapInArrow(releasing(_cut(chunk, overlap)), "sha string, start long, last boolean, part string")
        spread = parts.repartition(tasks, "sha", "start")
        spliced = written(_splice(spread.mapInArrow(releasing(_encode_chunks(path, chunk, overlap)), _SUMMARY)), "spliced")
        good = spliced.filter("n_tokens IS NOT NULL")
        counted = good if counted is None else counted.unionByName(good)
        failed = spliced.filter("n_tokens IS NULL").select("sha")
        if failed.isEmpty():
            break
        overlap *= WIDEN
        chunk = max(chunk, 2 * overlap)
        left = texts.join(failed, "sha", "left_semi")
    return short.unionByName(keyed.join(counted, "sha").select("doc_id", "n_bytes", "n_tokens"))
