"""Near-duplicates, line dedup, archives, urls and resampling against brute force."""

import base64
import hashlib
import random
import re

import pytest
import xxhash

from tokenfold.llm import importance, line_dedup, simhash, url_filters, warc
from tokenfold.llm.common import scratch_path


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable over pairs of at most two differing bits; prints: id to fingerprint."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in prints}


def test_simhash(spark):
    chance = random.Random(2)
    vocab = [f"W{k}" for k in range(50)]
    base = [chance.choice(vocab) for _ in range(200)]
    texts = ["", None, " \t", "One", "one two", "ONE two"]
    for k in range(60):
        other = list(base)
        other[k % 7] = "x"
        texts.append(" ".join(other if k % 2 else [chance.choice(vocab) for _ in range(20)]))
    docs = spark.createDataFrame([*[(i, x, 0) for i, x in enumerate(texts)], (7, texts[7], 0), (None, "one two", 0)], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    prints = {i: brute_print(x) for i, x in enumerate(texts)}
    wanted = brute_components(prints)
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id == wanted[4]
        else:
            assert (r.fp % (1 << 64), r.component_id) == (prints[r.doc_id], wanted[r.doc_id])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_trie_finds_every_link(spark):
    chance = random.Random(4)
    seeds = [chance.getrandbits(64) for _ in range(40)]
    values = set(seeds)
    for s in seeds:
        for flips in (1, 2, 3):
            values.add(s ^ sum(1 << b for b in chance.sample(range(64), flips)))
    values = sorted(values)
    prints = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "rep long, fp long")
    got = {tuple(r) for r in simhash.linked(prints).collect()}
    assert got == {(i, k) for i, a in enumerate(values) for k, b in enumerate(values) if i < k and (a ^ b).bit_count() <= 2}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_line_dedup(spark):
    chance = random.Random(6)
    vocab = [f"w{k}" for k in range(40)]
    lines = [" ".join(chance.sample(vocab, chance.randint(3, 14))) for _ in range(60)]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(chance.randint(0, 5)):
            words = chance.choice(lines).split()
            if chance.random() < 0.5:
                words[chance.randrange(len(words))] = chance.choice(vocab)
            own.append((" " if chance.random() < 0.5 else "\t").join(words).upper())
        texts.append("\n".join(own))
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(90, None, ""), (91, "", "")], "doc_id long, text string, removed string")
    seen, gone = [], {}
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            words = set(line.lower().split())
            if len(words) >= 5:
                if any(5 * len(words & o) >= 4 * len(words | o) for o in seen):
                    gone.setdefault(i, []).append(k)
                seen.append(words)
    rows = {r.doc_id: r for r in line_dedup.summary(docs, counters=1 << 10).collect()}
    assert {i: r.removed for i, r in rows.items() if r.removed} == gone and gone
    assert rows[90].n_lines == 1 and len(rows) == 62
    left = {r.doc_id: r for r in line_dedup.dedup_lines(docs, counters=1 << 10).collect()}
    assert left[90].text is None and left[91].text == "" and left[0].removed == "clash"
    for i, text in enumerate(texts):
        assert left[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(i, []))


def test_line_dedup_edges(spark):
    line = "one two three four five six"
    rows = [(1, line), (1, line), (None, line + " seven"), (2, line + "\n" + line)]
    got = line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string"), counters=1 << 10).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 2)]
    assert line_dedup.summary(spark.createDataFrame([], "doc_id long, text string"), counters=1 << 10).count() == 0


@pytest.mark.parametrize("range_bytes", [1 << 20, 997, 61])
def test_warc(spark, range_bytes):
    big = "x" * 200_000
    pages = [(1, "http://a/", "same"), (5, "http://b/\r\nX: 1", "same"), (3, None, None), (4, "u", ""), (2, "u", "\x1f\x8b\u0008\u00e9"), (7, "u", big), (None, "u", big), (8, "u", "same")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    archives = warc.write(frame.repartition(3), scratch_path(spark, "warc"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, archives, range_bytes).collect()), key=str)
    last = {}
    for p, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    wanted = []
    for p, _, h in pages:
        raw, top = (h or "").encode(), last[h or ""]
        copy = p is not None and p < top
        wanted.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if copy else "response", top if copy else None))
    assert got == sorted(wanted, key=str)
    assert warc.read(spark, archives.limit(0)).count() == 0
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_urls(spark):
    urls = [
        (1, "http://WWW.Example.COM/en/7x?q#f"), (2, "https://shop.com/en/1"), (3, "x://net/de/8"), (4, "x://a.example.net/de/8"), (5, None),
        (6, "no scheme"), (7, "http://org/es/"), (8, "http://notcom/en/"), (9, "://h?x/en/"), (9, "://h?x/en/"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame([(*u, "t") for u in urls], "page_id long, url string, template string")).collect()}
    assert got == {
        1: ("www.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("shop.com", "/en/1", "com/en/", "block"),
        3: ("net", "/de/8", "net/de/", "allow"), 4: ("a.example.net", "/de/8", "example.net/de/8", "block"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("org", "/es/", "org/es/", "block"), 8: ("notcom", "/en/", None, "allow"), 9: ("h", "", None, "allow"),
    }


def test_url_templates(spark):
    """Pages under a template whose labelled pages are blocked go; its sibling without labels stays."""
    rules = (url_filters.Rule("block", "h", "/a/1"),)
    urls = [f"http://h/a/{k}" for k in [*range(10, 20), *range(100, 200), *range(200, 230)]] + [f"http://h/b/{k}.html" for k in range(50)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filters.judge(pages, rules).collect()
    assert {r.template for r in rows} == {"/a/*", "/b/*.html"}
    assert {(r.template, r.verdict) for r in rows if r.rule is None} == {("/a/*", "block"), ("/b/*.html", "allow")}


def test_importance(spark):
    chance = random.Random(8)
    good, bad = [f"g{k}" for k in range(60)], [f"b{k}!!" for k in range(60)]
    rows = [(i, " ".join(chance.choice(bad if i % 5 == 0 else good) for _ in range(40)), 1.0) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, 1.0), (901, "", 1.0), (None, "g1 g2", 1.0)], "doc_id long, text string, key double")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    drawn = {r.doc_id: r for r in importance.resample(docs, labels).collect()}
    assert len(drawn) == 403
    assert not any(drawn[i].selected for i in range(0, 400, 5))
    assert sum(drawn[i].selected for i in range(400) if i % 5) > 300
    assert importance.resample(docs.limit(0), labels).count() == 0
    assert importance.resample(docs, labels.limit(0)).filter("selected").count() == 403


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(importance, "LAST_KEYS", 5)
    values = [random.Random(1).gauss(0, 1) for _ in range(500)] + [0.5] * 20
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 180, 520):
        assert importance.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(keys, 521) is None


