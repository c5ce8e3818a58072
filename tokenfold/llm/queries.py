"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tokenfold.llm import bpe, centroids, decontaminate, html_text, importance, line_dedup, negatives, quality_rules, simhash, token_counts, toxicity, url_filters, warc
from tokenfold.llm.common import table
from tokenfold.llm.oracles import ORACLES


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with byte_bpe_50k and decoded again: digests of ids and text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that an earlier line of the corpus matches, by their numbers."""
    found = line_dedup.summary(table(spark, sf_dir, "documents"), min_words=line_dedup.NON_BLANK)
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte_bpe_50k tokens of every document, and whether it exceeds 1024 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), path)
    return counts.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 AS over_limit")


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document, and whether Gumbel top-k keeps it."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.withColumnRenamed("selected", "kept")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url, with its template."""
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a benchmark window, and the items concerned."""
    scanned = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.verdicts(scanned).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of the held-out third are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of policy v2 for every document."""
    judged = quality_rules.judge(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")
    base = quality_rules.policy_mask("base")
    return judged.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        f"(failures & {base}) != 0 AS base_failed", "kept", "failures",
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest doc_id of its near-duplicate group."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every embedding after ten rounds, with the clusters' inertia and centroid digests."""
    return centroids.digests(centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: its blocks joined by line feeds."""
    blocks = html_text.extract(table(spark, sf_dir, "pages"))
    return blocks.select("page_id", "url", F.array_join("blocks", "\n").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, by anchor and positive; the contract's labels are shifted first."""
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", shifted.alias("label"), "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
