"""A corpus pipeline in five stages, each an operator of ``tokenfold.llm`` on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenfold.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from tokenfold.llm.common import table, written


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, scores below its threshold.

    Null and empty texts are scored as texts without a hit; repeated rows stay or go together.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = _unused(docs, "toxicity")
    return toxicity.score(docs, model, name).filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the non-blank lines that an earlier line matches; null texts stay null, repeated rows stay alike."""
    left = line_dedup.dedup_lines(docs, min_words=line_dedup.NON_BLANK)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the row with the smallest id; rows without an id stay.

    Rows with the same id and another text are told apart by the text's hash; of rows with the same id and text one stays.
    """
    mark, many = _unused(docs, "mark"), _unused(docs, "many")
    own = ["doc_id", mark]
    best = simhash.near_copies(docs).filter(F.col("component") == F.struct("doc_id", "mark"))
    found = best.select("doc_id", F.col("mark").alias(mark))
    rows = docs.filter("doc_id IS NOT NULL").withColumn(mark, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    again = written(rows.groupBy(*own).agg((F.count("*") > 1).alias(many)).filter(F.col(many)), "again")
    kept = rows.join(found, own)
    if not again.isEmpty():
        kept = kept.join(again, own, "left")
        kept = kept.filter(F.col(many).isNull()).unionByName(kept.filter(F.col(many)).dropDuplicates(own))
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and wordless texts stay, repeated rows stay or go together."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text")
    scanned = decontaminate.scan(rows, table(spark, sf_dir, "benchmark"), keep=("row",))
    clean = scanned.filter(F.size("items") + F.size("ranges") == 0)
    return clean.select("row.*", "text").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit), and digests of them and of the text they decode to.

    A null text is read as the empty one, of no tokens; each repeated row has its own result.
    """
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL expresses neither the toxicity model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
