"""The pipeline from end to end on a small table, edge rows included, against plain Python."""

import hashlib
import math
import random
import struct

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tokenfold.llm import toxicity


TOXIC = range(15, 30)


def _tables(spark, folder):
    draw = random.Random(4)
    vocab = [f"word{k}" for k in range(900)]

    def line(n=12):
        return " ".join(draw.choice(vocab) for _ in range(n))

    rows = [(k, "\n".join(line() for _ in range(6))) for k in range(60)]
    shared = line()
    for k in range(5, 14):
        rows[k] = (k, rows[k][1] + "\n" + shared)
    for k in TOXIC:
        rows[k] = (k, rows[k][1] + "\nyou stupid worthless idiot moron scum " + line(3))
    item = line(14)
    rows[30] = (30, rows[30][1] + "\nbefore it " + item.upper() + " after it")
    rows += [(60, rows[40][1] + " tail"), (61, ""), (62, None), (63, "\n \n"), (64, "x"), (65, "x"), (None, line()), (66, " ".join(line() for _ in range(300)))]
    rows += [rows[3], rows[3]]
    docs = [(i, t, "en", "web", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in TOXIC)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("a", item), ("b", None), ("c", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, item


def _scored(model, text):
    found = {p for p in toxicity.patterns(text or "") if p in model.voters}
    odds = model.bias + model.count_weight * math.log1p(len(found)) + sum(dict(zip(model.voters, model.weights))[p] for p in found)
    return 1 / (1 + math.exp(-max(-30, min(30, odds))))


def _without_repeated_lines(rows):
    """Later lines that match an earlier one by (doc_id, line) go; equal rows are one text."""
    seen, done = [], {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, own = [], []
        for one in (text or "").split("\n"):
            words = set(one.lower().split())
            if words and any(5 * len(words & o) >= 4 * len(words | o) for o in [*seen, *own]):
                continue
            kept.append(one)
            own += [words] if words else []
        seen += own
        done[i, text] = None if text is None else "\n".join(kept)
    return [(i, done[i, t]) for i, t in rows]


def _one_of_each(rows):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)} - {()}

    named = sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0])
    kept, sets = [r for r in rows if r[0] is None], []
    for row in named:
        own = shingles(row[1])
        if not any(own == o or 5 * len(own & o) >= 4 * len(own | o) for o in sets):
            kept.append(row)
        sets.append(own)
    return kept


def test_pipeline_equals_a_plain_one(spark, tmp_path):
    rows, item = _tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [r for r in rows if _scored(model, r[1]) < toxicity.THRESHOLD]
    assert {r[0] for r in rows} - {r[0] for r in left} == set(TOXIC)
    left = _one_of_each(_without_repeated_lines(left))
    left = [r for r in left if f" {item} " not in " " + " ".join((r[1] or "").lower().split()) + " "]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, text in left:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        packed, decoded = struct.pack(f"<{len(ids)}I", *ids), tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((-1 if i is None else i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    made = corpus_pipeline.run(spark, str(tmp_path)).select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, made)) == sorted(expected)


def test_toxicity_does_not_depend_on_partitions(spark, tmp_path):
    _tables(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs.repartition(7), labels.repartition(3))


def test_stages_keep_columns_with_the_names_they_use(spark, tmp_path):
    _tables(spark, tmp_path)
    names = ["toxicity", "_toxicity", "mark", "_mark", "many", "component", "node", "row"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce("doc_id", F.lit(-1))) for n in names})
    few = docs.filter("doc_id < 5 OR doc_id IN (20, 62) OR doc_id IS NULL")
    ids = {r.doc_id for r in docs.collect()}
    for stage, given, kept in (
        (corpus_pipeline.drop_toxic, docs, ids - set(TOXIC)),
        (corpus_pipeline.keep_one_of_each, few, {0, 1, 2, 3, 4, 20, 62, None}),
    ):
        left = stage(spark, given, str(tmp_path))
        assert left.columns == docs.columns
        made = left.collect()
        assert {r.doc_id for r in made} == kept
        assert all(r[n] == f"{n} {-1 if r.doc_id is None else r.doc_id}" for r in made for n in names)
