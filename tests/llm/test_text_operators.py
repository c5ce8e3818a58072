"""Encoding, counting, rules, decontamination and toxicity against the libraries and brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tokenfold.llm import bpe, decontaminate, quality_rules, token_counts, toxicity, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "a<|endoftext|>b", "x  <|endoftext|>  y <|endof", "\u0558a\u058b 1", "a\u180eb \u2003 c\u3000d\u00a0 e",
    "it's we'll I'D", "\x1c\x1f a\x85b", "\U0001f600\u200d\u2764 q", "\u0661\u0662 abc", "\n\n\n a\t\tb  ", "word " * 3000, "a", "a",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, "clash", i) for i, x in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, n_words long")


def test_encode_and_decode(spark, odd, tokenizer):
    made = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    fused = {r.doc_id: r for r in bpe.encode(odd, PATH, decoded=True).collect()}
    assert sorted(r.doc_id for r in made) == list(range(len(ODD)))
    for r in made:
        text = ODD[r.doc_id] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.n_tokens == len(ids)
        assert r.decoded == fused[r.doc_id].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0), PATH).count() == 0


def test_word_pattern_agrees_with_the_library(tokenizer):
    """Java reads the same pattern; here the classes of every settled code point are compared."""
    import regex

    pattern = regex.compile(vocabulary.WORDS)
    chance = random.Random(5)
    settled = [c for a, b in vocabulary.SETTLED for c in range(a, b + 1)]
    for _ in range(300):
        text = "".join(chr(chance.choice(settled)) if chance.random() < 0.5 else chance.choice(" \n\t'ab1.") for _ in range(60))
        assert [m.span() for m in pattern.finditer(text)] == [x[1] for x in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_token_counts_with_splices(spark, tokenizer):
    texts = ["ab cd. " * 500, "x" * 3000, " " * 2500, "a<|endoftext|> " * 300, "\u00e91 " * 900 + "z" * 1000, "", None, "hi"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = token_counts.count_tokens(docs, PATH, chunk=200, overlap=40).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(tokenizer.encode(text, add_special_tokens=False).ids), len(text.encode()))
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, PATH, chunk=10, overlap=20)


def brute_rules(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {g for g in grams if grams.count(g) > 1}
    hit = {i + k for i, g in enumerate(grams) if g in again for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd):
    texts = ["a b c d e a b c d e f", "x\nx\n\n \ny|y\n\u00e9\u00e9", "q " * 40, "\x0b a\x0c"] + ODD[:-3]
    docs = spark.createDataFrame([(i, x, "s", 1) for i, x in enumerate(texts)], "doc_id long, text string, words string, n int")
    rows = quality_rules.ledger(docs).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(texts[r.doc_id]), texts[r.doc_id]
    assert len(rows) == len(texts)
    ledger = quality_rules.ledger(docs)
    kept = {r.doc_id for r in quality_rules.judge(ledger, "base").filter("kept").collect()}
    assert kept == {i for i, t in enumerate(texts) if brute_rules(t)[0] >= 10 and 100 * brute_rules(t)[4] <= 20 * brute_rules(t)[0]}
    ablation = {r.rule: r for r in quality_rules.ablations(ledger, "base").collect()}
    assert ablation["few_words"].rejected == sum(brute_rules(t)[0] < 10 for t in texts)
    assert ablation["few_words"].kept_without >= len(kept)
    assert quality_rules.ablations(ledger.limit(0), "v2").agg(F.sum("rejected")).first()[0] == 0
    with pytest.raises(KeyError):
        quality_rules.policy_mask("none")


def brute_hits(text, items):
    fold = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words, hit, names = fold(text), set(), set()
    for item, t in items:
        own = fold(t)
        for k in range(max(1, len(own) - 9)) if own else ():
            window = own[k : k + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    names |= {str(item)} - {"None"}
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("per_pass", [1000, 3])
def test_decontamination(spark, per_pass):
    chance = random.Random(3)
    vocab = ["alpha", "b\u00e9ta", "c3", "d", "e"]
    items = [(k, ", ".join(chance.choice(vocab) for _ in range(chance.choice([2, 9, 10, 13])))) for k in range(6)] + [(9, ""), (10, None), (None, "alpha d alpha"), (3, "only this")]
    texts = ["", None, "... !", "Only  THIS, and more", *[" ".join(chance.choice(vocab) for _ in range(60)) for _ in range(4)]]
    texts += ["Start: " + (items[0][1] or "").upper().replace("\u00c9", "\u00e9") + "; end", items[1][1]]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    scanned = decontaminate.scan(docs, bench, windows_per_pass=per_pass)
    spans = {r.doc_id: r.spans for r in scanned.collect()}
    for r in decontaminate.verdicts(scanned).collect():
        n_words, n_hit, names = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(names), n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        raw = (texts[r.doc_id] or "").encode()
        inside = [raw[a:b].decode() for a, b in zip(spans[r.doc_id][::2], spans[r.doc_id][1::2])]
        assert sum(brute_hits(x, [])[0] for x in inside) == n_hit
    assert decontaminate.verdicts(decontaminate.scan(docs, bench.limit(0))).filter("contaminated").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


def test_toxicity_on_held_out_rows(spark):
    chance = random.Random(1)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = [chance.choice(plain) for _ in range(30)] + ([chance.choice(["grumla", "grumlan", "grumlesk", "idiot", "zworp"]) for _ in range(3)] if bad else [])
        chance.shuffle(words)
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None, 0.1), (1001, "", 0.1), (None, "idiot", 0.1)], "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score"] and scored.count() == 903
    held = scored.filter(toxicity.is_held_out(F.col("doc_id"))).join(known, "doc_id").filter("toxic IS NOT NULL").collect()
    wrong = sum((r.score >= toxicity.THRESHOLD) != bool(r.toxic) for r in held)
    assert len(held) > 250 and wrong <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 for r in scored.collect())
    without = toxicity.fit(docs, known.limit(0))
    assert {r.doc_id for r in toxicity.score(docs, without).filter("score >= 0.7").collect() if r.doc_id} <= {i for i in range(0, 900, 6)}
    assert toxicity.score(docs.limit(0), model).count() == 0
