"""Quality rules as a bitmask ledger (native DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule, so a policy is a mask over those bits: changing a policy, comparing two versions or
asking what a rule alone rejects never touches the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.llm.common import SPACE_CLASS

#: Words in a repeated window.
WINDOW = 5

#: The counted symbols.
SYMBOLS = "#*$%&|<>"


def _windows(words: Column, n: Column) -> Column:
    starts = F.sequence(F.lit(0), n - WINDOW)
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]))


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document row: its id and the measurements that rules use.

    Null texts count as empty (all measurements 0). Repeated rows and null ids are kept as they
    are, other columns are ignored. Work is per row, without a shuffle. The word windows are
    first compared by hash; only a text with two equal hashes compares the windows themselves.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    split = base.select(
        "doc_id",
        text.alias("text"),
        F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").alias("n"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.translate("text", "!", ""))).alias("n_exclaims"),
        F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    hashed = counted.withColumn(
        "marks",
        F.when(
            F.col("n") > WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.col("n") - WINDOW),
                lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(WINDOW)]),
            ),
        ),
    )
    flagged = hashed.withColumn("repeats", F.coalesce(F.size(F.array_distinct("marks")) < F.size("marks"), F.lit(False)))
    grouped = flagged.withColumn("grams", F.when(F.col("repeats"), _windows(F.col("words"), F.col("n"))))
    ordered = grouped.withColumn(
        "ordered",
        F.when(
            F.col("repeats"),
            F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ),
    )
    count = F.size("ordered") - 1
    again = F.zip_with(
        F.slice("ordered", F.lit(1), count),
        F.slice("ordered", F.lit(2), count),
        lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])),
    )
    positions = ordered.withColumn(
        "positions",
        F.when(
            F.col("repeats"),
            F.array_sort(F.array_distinct(F.flatten(F.filter(again, lambda x: x.isNotNull())))),
        ),
    )
    covered = F.aggregate(
        F.coalesce("positions", F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda at, i: F.struct(
            (i + WINDOW).alias("end"), (at["total"] + i + WINDOW - F.greatest(i, at["end"])).alias("total")
        ),
        lambda at: at["total"],
    )
    longs = ["word_chars", "n_symbols", "n_exclaims", "n_upper", "n_lines", "n_dup_lines"]
    return positions.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        *[F.col(c).cast("long").alias(c) for c in longs],
        covered.cast("long").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """A rule: its bit in the ledger and the condition under which a document fails it."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


#: A rule keeps its bit for ever; a changed condition is a new rule with a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "exclaims", "100 * n_exclaims > 20 * n_words"),
    Rule(7, "capitals", "100 * n_upper > 50 * word_chars"),
)

#: Versioned policies: a document stays if it fails none of the policy's rules.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
    "v2": tuple(r.name for r in RULES),
}


def policy_mask(version: str, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits that a policy version looks at; an unknown version raises KeyError."""
    by_name = {r.name: r.mask for r in rules}
    mask = 0
    for name in POLICIES[version]:
        mask |= by_name[name]
    return mask


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **columns: str) -> DataFrame:
    """``measure`` plus ``failures``: one bit per failed rule. Every rule is evaluated here, once."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(rule.mask)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, **columns).withColumn("failures", bits)


def judge(ledger_df: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept``: no bit of the policy's mask is set."""
    return ledger_df.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(ledger_df: DataFrame, version: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: rejected documents, those rejected by no other rule, and those kept without it.

    The ledger is first counted by its failure bits (at most 2**rules rows, combined before the
    shuffle); every figure comes from those counts by bitwise tests. Empty ledgers give zeros.
    """
    mask = policy_mask(version, rules)
    counts = ledger_df.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if r.mask & mask]
    sums = []
    for r in chosen:
        sums.append(F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(r.mask)) != 0, F.col("n"))), F.lit(0)))
        sums.append(F.coalesce(F.sum(F.when(F.col("bits") == r.mask, F.col("n"))), F.lit(0)))
        rest = mask & ~r.mask
        sums.append(F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(rest)) == 0, F.col("n"))), F.lit(0)))
    one = counts.agg(
        F.array(
            *[
                F.struct(
                    F.lit(r.name).alias("rule"),
                    sums[3 * i].alias("rejected"),
                    sums[3 * i + 1].alias("only_this"),
                    sums[3 * i + 2].alias("kept_without"),
                )
                for i, r in enumerate(chosen)
            ]
        ).alias("rows")
    )
    return one.select(F.inline("rows"))
