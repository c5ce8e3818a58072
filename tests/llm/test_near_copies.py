"""Near copies whose buckets hold many other texts between them, against brute force."""

import random

from tokenfold.llm import simhash


def _texts():
    """Pairs at a similarity of about 0.82, in a crowd of texts of about 0.74 that share their buckets."""
    draw = random.Random(11)
    base = [f"w{k}" for k in range(204)]

    def changed(words, count):
        words = list(words)
        for at in draw.sample(range(4, 200), count):
            words[at] = f"x{draw.random()}"
        return words

    first = [changed(base, 3) for _ in range(250)]
    return [" ".join(words) for words in [*first, *[changed(words, 4) for words in first]]]


def _shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_every_link_is_found(spark):
    texts = _texts()
    sets, least = [_shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for j, own in enumerate(sets):
        for i in range(j):
            if 5 * len(own & sets[i]) >= 4 * len(own | sets[i]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component.doc_id for r in simhash.near_copies(docs).collect()}
    assert got == {k: root(k) for k in range(len(texts))}


def test_only_shared_shingles_are_held_as_entries(spark, monkeypatch):
    """While entries are written the whole sets are gone, and texts without a shared shingle have no entry."""
    draw, held, rows = random.Random(12), [], []
    texts = [" ".join(f"w{draw.random()}" for _ in range(300)) for _ in range(60)]
    texts[1] = " ".join([*texts[0].split()[:60], *texts[1].split()[60:]])
    deleted, kept = simhash.Scratch.__exit__, simhash.Scratch.written

    def writing(self, df, name, *more):
        if name == "entries":
            rows.append(df.count())
            held.extend(live)
        live.append(name)
        self.names = [*getattr(self, "names", []), name]
        return kept(self, df, name, *more)

    def leaving(self, *more):
        for name in getattr(self, "names", []):
            live.remove(name)
        return deleted(self, *more)

    live = []
    monkeypatch.setattr(simhash.Scratch, "written", writing)
    monkeypatch.setattr(simhash.Scratch, "__exit__", leaving)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component.doc_id for r in simhash.near_copies(docs).collect()} == set(range(60))
    assert "prefixes" in held and "shingles" not in held, held
    assert rows[0] <= 2 * 61 and not live
