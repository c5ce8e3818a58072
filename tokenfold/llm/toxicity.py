"""Toxicity by weak supervision: many noisy voters, a generative label model, a linear classifier.

Voters are the words of a small lexicon and word patterns (whole words and word beginnings) mined
from labelled rows. A latent-class model estimates how often each voter fires on toxic and on
clean texts, and which voters repeat each other. Its posterior labels train a linear classifier,
and that scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.llm.common import SPACE_CLASS, releasing, written

#: Insults that vote for "toxic" without any label (fixed values).
LEXICON = (
    "clown", "coward", "creep", "disgusting", "dumb", "failure", "filth", "fool", "garbage",
    "hateful", "idiot", "imbecile", "jerk", "liar", "loser", "moron", "nasty", "pathetic", "pig",
    "rat", "repulsive", "scum", "stupid", "trash", "ugly", "vermin", "vile", "worthless",
)

#: Labelled rows that the model is fitted on, at most; the smallest by a hash of doc_id.
FIT_ROWS = 20_000

#: Mined voters, at most, and what a pattern needs to become one: toxic rows (a number, and a share
#: of all toxic rows), and their share of the rows that have it.
VOTERS, SUPPORT, SUPPORT_SHARE, PRECISION = 400, 4, 0.01, 0.8

#: Texts are copies if their smallest hashes of so many words in a row, so many of them, all agree.
COPY_WORDS, COPY_HASHES = 3, 8

#: Lengths of word beginnings; a whole word is a pattern too.
PREFIXES = (4, 5, 6)

#: Score from which a text counts as toxic.
THRESHOLD = 0.7


def is_held_out(doc_id: Column) -> Column:
    """The third of rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def patterns(text: str) -> set[str]:
    """The words of a text, and their beginnings with a trailing ``*``."""
    import re

    words = set(re.findall(r"\w+", text.lower()))
    found = set(words)
    for size in PREFIXES:
        found.update([w[:size] + "*" for w in words if len(w) > size])
    return found


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for toxic, text in zip(batch.column(1), batch.column(2)):
            found = sorted(patterns(text.as_py() or ""))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic.as_py()] * len(found), pa.int32())], ["pattern", "toxic"])


def _vote(voters: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {v: k for k, v in enumerate(voters)}
        for batch in batches:
            fired = [sorted(index[p] for p in patterns(t.as_py() or "") if p in index) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fired, pa.list_(pa.int32()))], ["toxic", "fired"])

    return run


@dataclass(frozen=True)
class Model:
    """A fitted classifier: a weight per voter, one for the log of how many fired, and the bias."""

    voters: tuple[str, ...]
    weights: tuple[float, ...]
    count_weight: float
    bias: float


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Up to ``rows`` labelled documents that are not held out: doc_id, toxic, text; a written table.

    The sample's ids are at most ``rows``, so that side is broadcast. Of copies with the same label
    the one with the smallest id stays: copies would make every word of theirs a pattern. Texts that
    share a part J of their shingles count as copies with a chance of J to the power of
    ``COPY_HASHES``; texts with fewer shingles than that, only if all of them are the same.
    """
    usable = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), f"{SPACE_CLASS}+"), "")
    split = texts.withColumn("words", words)
    hashes = F.when(
        F.size("words") >= COPY_WORDS,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - COPY_WORDS),
            lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(COPY_WORDS)])),
        ),
    ).otherwise(F.array(F.xxhash64(F.array_join("words", " "))))
    mark = F.slice(F.sort_array(F.array_distinct(hashes)), 1, COPY_HASHES)
    marked = split.select(mark.alias("mark"), "toxic", F.struct("doc_id", "text").alias("row"))
    kept = marked.groupBy("mark", "toxic").agg(F.min("row").alias("row"))
    return written(kept.select("row.doc_id", "toxic", "row.text"), "fit_sample")


def mine_voters(sample: DataFrame) -> list[str]:
    """Patterns that mark toxic texts, the lexicon first; at most ``VOTERS`` mined ones."""
    toxic = sample.agg(F.sum("toxic")).first()[0] or 0
    least = max(SUPPORT, round(SUPPORT_SHARE * toxic))
    counts = (
        sample.mapInArrow(releasing(_mine), "pattern string, toxic int")
        .groupBy("pattern")
        .agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
        .filter((F.col("bad") >= least) & ((F.col("bad") + 0.5) / (F.col("n") + 1) >= PRECISION))
    )
    best = counts.orderBy(F.desc("bad"), F.length("pattern"), "pattern").limit(VOTERS).collect()
    return [*LEXICON, *[r.pattern for r in best if r.pattern not in LEXICON]]


def label_model(fires, start, rounds: int = 12):
    """Posterior P(toxic) of each row under a latent-class model of the voters.

    ``fires`` is a rows x voters 0/1 matrix: a voter votes "toxic" or abstains, and an abstention
    says nothing, but one more voter votes "clean" where all abstain. ``start`` are the labels,
    which are one more voter and the first guess. Each voter has a rate of firing on toxic and on
    clean rows, from which its accuracy follows. The correlation of two voters among rows of one
    class says how far they repeat each other; a voter's log odds are divided by its total
    correlation with all voters, itself included.
    """
    import numpy as np

    quiet = (fires.sum(1) == 0).astype(float)[:, None]
    votes = np.hstack([fires, quiet, start[:, None], 1 - start[:, None]])
    posterior = np.clip(start, 0.02, 0.98)
    share = np.ones(votes.shape[1])
    for step in range(rounds):
        mass = posterior.sum(), (1 - posterior).sum()
        on_toxic = (votes.T @ posterior + 0.1) / (mass[0] + 1)
        on_clean = (votes.T @ (1 - posterior) + 0.1) / (mass[1] + 1)
        if step % 4 == 0:
            centred = fires - np.outer(posterior, on_toxic[:-3]) - np.outer(1 - posterior, on_clean[:-3])
            spread = np.sqrt((centred**2).mean(0)) + 1e-9
            together = np.abs(centred.T @ centred / len(fires)) / np.outer(spread, spread)
            share[:-3] = 1 / np.where(together > 0.25, together, 0).sum(0).clip(1)
        odds = np.log(mass[0] / mass[1]) + votes @ (np.log(on_toxic / on_clean) * share)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior


def train(features, target, penalty: float = 1.0, rounds: int = 30):
    """Weights and bias of a logistic regression on soft targets, by Newton steps."""
    import numpy as np

    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents; without any, the lexicon's words alone count."""
    import numpy as np

    sample = fit_sample(docs, labels, rows)
    voters = mine_voters(sample)
    held = sample.mapInArrow(releasing(_vote(voters)), "toxic int, fired array<int>").collect()
    toxic = np.array([r.toxic for r in held], float)
    if not len(held) or toxic.min() == toxic.max():
        return Model(tuple(voters), (0.0,) * len(voters), 4.0, -2.0)
    fires = np.zeros((len(held), len(voters)))
    for k, r in enumerate(held):
        fires[k, r.fired] = 1
    posterior = label_model(fires, toxic)
    count = np.log1p(fires.sum(1))[:, None]
    weights, bias = train(np.hstack([fires, count]), posterior)
    return Model(tuple(voters), tuple(map(float, weights[:-1])), float(weights[-1]), bias)


def _score(model: Model, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math
        import re

        weight = dict(zip(model.voters, model.weights))
        get, words_of = weight.get, re.compile(r"\w+").findall
        for batch in batches:
            scores = []
            for text in batch.column(at):
                hits = {w for w in _candidates(words_of, (text.as_py() or "").lower()) if w in weight}
                odds = model.bias + model.count_weight * math.log1p(len(hits)) + sum(map(get, hits))
                scores.append(1 / (1 + math.exp(-min(30.0, max(-30.0, odds)))))
            yield batch.append_column(name, pa.array(scores, pa.float64()))

    return run


def _candidates(words_of, text: str) -> Iterator[str]:
    for word in set(words_of(text)):
        yield word
        for size in PREFIXES:
            if len(word) <= size:
                break
            yield word[:size] + "*"


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of the whole text in column ``name``; it is of the text alone.

    Null and empty texts get the score of a text in which no voter fires. Repeated rows score
    alike; all columns stay, but one called ``name`` is replaced. Nothing is shuffled.
    """
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(releasing(_score(model, docs.columns.index("text"), name)), schema)
