"""Jobs are done in whole: nothing that should count is left out beforehand."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tokenfold.llm import queries, toxicity, url_filters


def test_fit_sample_drops_copies_only(spark):
    chance = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    texts = [" ".join(["are", *[chance.choice(vocab) for _ in range(200)], *vocab[:50]]) for _ in range(60)]
    rows = [*enumerate(texts), *[(k + 100, texts[k].replace(" ", "\n ").upper()) for k in range(60)], (200, ""), (201, None), (202, "are")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i, _ in rows], "doc_id long, toxic int")
    used = [r.doc_id for r in docs.filter(~toxicity.is_held_out(F.col("doc_id"))).select("doc_id").collect()]
    text_of, first = dict(rows), {}
    for i in sorted(used):
        first.setdefault((" ".join((text_of[i] or "").lower().split()), int(i % 7 == 0)), i)
    got = toxicity.fit_sample(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(first.values()) and len(got) > 60
    assert all(r.text == text_of[r.doc_id] and r.toxic == int(r.doc_id % 7 == 0) for r in got)


def test_near_duplicate_stage_finds_copies_at_four_fifths(spark):
    chance = random.Random(9)
    vocab = [f"w{k}" for k in range(3000)]
    rows, copies = [], set()
    for k in range(40):
        words = [chance.choice(vocab) for _ in range(200)]
        other = list(words)
        for at in (20, 80, 140):  # 15 of 196 shingles differ: Jaccard 181 / 211
            other[at] = "x"
        far = list(words)
        for at in range(10, 200, 20):  # 50 of 196 shingles differ: Jaccard 146 / 246
            far[at] = "y"
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(other)), (3 * k + 2, " ".join(far))]
        copies.add(3 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()}
    assert left == {i for i, _ in rows} - copies


def test_near_duplicate_stage_tells_texts_of_one_id_apart(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(1, one), (1, two), (1, two), (0, two), (2, ""), (3, None), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.keep_one_of_each(spark, docs, "").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in left) == [(-1, one), (0, two), (1, one), (2, "")]


def test_lines_of_few_distinct_words_are_compared(spark, tmp_path):
    texts = [
        "Intro\n\nla la la la la\na b c d e", "intro\n\nA b  c d\nla x", "你好世界\nd c b a", "你好世界\n\nla",
        "a b c\nx y z", "c b a\na b\nx y w\n",
    ]
    seen, expected = [], {}
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            words = set(line.lower().split())
            if words:
                if any(5 * len(words & o) >= 4 * len(words | o) for o in seen):
                    expected.setdefault(i, []).append(str(k))
                seen.append(words)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed_lines for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(expected.get(i, [])) for i in range(len(texts))} and len(expected) == 4


def test_labels_reach_branches_without_rules(spark):
    """Rules cover /en only: /de takes its siblings' purity, the odd page its host's; other hosts stay."""
    rules = (url_filters.Rule("block", "bad", "/en/"), url_filters.Rule("allow", "good", "/en/"))
    paths = [f"/{c}/{k}{end}" for c in ("en", "de") for k in range(40) for end in ("", ".html")] + ["/odd/page", "/"]
    urls = [f"http://{host}{path}" for host in ("bad", "good", "other") for path in paths]
    rows = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(rows) == len(urls)
    assert {(r.host, r.verdict) for r in rows if r.rule is None} == {("bad", "block"), ("good", "allow"), ("other", "allow")}
