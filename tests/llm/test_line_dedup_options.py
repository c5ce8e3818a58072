"""Line dedup under other thresholds, where small sets match with one shared word, against brute force."""

import random

import pytest

from tokenfold.llm import line_dedup, sets


def _documents():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    bases = [[draw.choice(words) for _ in range(draw.randint(1, 14))] for _ in range(12)]
    for doc_id in range(80):
        lines = []
        for _ in range(draw.randint(1, 3)):
            line = list(draw.choice(bases))
            for _ in range(draw.randint(0, 2)):
                line[draw.randrange(len(line))] = draw.choice(words)
            lines.append(" ".join(line))
        yield doc_id, "\n".join(lines)


@pytest.mark.parametrize(("similarity", "min_words"), [((4, 5), 1), ((1, 2), 1)])
def test_thresholds(spark, similarity, min_words):
    rows = list(_documents())
    top, bottom = similarity
    earlier, expected = [], {}
    for doc_id, text in rows:
        for i, line in enumerate(text.split("\n")):
            own = set(line.split())
            if len(own) >= min_words:
                if any(bottom * len(own & other) >= top * len(own | other) for other in earlier):
                    expected.setdefault(doc_id, []).append(i)
                earlier.append(own)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.removed_lines(docs, similarity=similarity, min_words=min_words).collect()
    assert {x.doc_id: list(x.removed) for x in found} == expected


def test_long_lines_are_told_apart_before_they_are_read(spark, monkeypatch):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    lines = [draw.sample(words, 130) for _ in range(300)]
    lines += [lines[k][:-5] for k in range(3)]
    docs = spark.createDataFrame([(k, " ".join(line)) for k, line in enumerate(lines)], "doc_id long, text string")
    read, verified = [], line_dedup._verified

    def counted(docs, pairs, similarity):
        read.append(pairs.count())
        return verified(docs, pairs, similarity)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    found = line_dedup.removed_lines(docs, counters=1 << 10).collect()
    assert sorted(x.doc_id for x in found) == [300, 301, 302]
    assert sum(read) <= 10, read


def test_words_are_counted_from_written_hashes_once_a_line(spark, monkeypatch):
    counted, joined = [], []
    levels, join = sets.levels, line_dedup._joined

    def counting(values, counters):
        counted.append(values._jdf.queryExecution().optimizedPlan().toString())
        return levels(values, counters)

    def joining(classes, *options):
        joined.append({x.n: list(x.prefix) for x in classes.collect()})
        return join(classes, *options)

    monkeypatch.setattr(sets, "levels", counting)
    monkeypatch.setattr(line_dedup, "_joined", joining)
    # No word is in two lines of different sets, however often it is in one.
    texts = ["a a a b b c d e\nf g h i j k f f", "l m n o p q r l l l"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert line_dedup.removed_lines(docs).collect() == []
    assert len(counted) == 1 and "split(" not in counted[0]
    assert joined == [{5: [], 6: [], 7: []}]


def test_families_share_a_window(spark, monkeypatch):
    """Members of a family lie side by side in a window of many families; each is held against its own only."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(2000)]
    lines = [draw.sample(words, 20) for _ in range(100)]
    lines += [[*line, f"only{k}"] for k, line in enumerate(lines)]
    count, join = [], line_dedup._joined

    def joining(classes, sure, similarity):
        count.append(sure.count())
        return join(classes, sure, similarity)

    monkeypatch.setattr(line_dedup, "_joined", joining)
    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", 1_000_000)
    docs = spark.createDataFrame([(k, " ".join(line)) for k, line in enumerate(lines)], "doc_id long, text string")
    removed = line_dedup.removed_lines(docs, counters=1 << 12).collect()
    assert sorted(x.doc_id for x in removed) == list(range(100, 200))
    assert count[0] >= 90, count
