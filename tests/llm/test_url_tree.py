"""The url tree against a plain one, on a generated site with paths of many levels."""

import math
import random
import re
from collections import Counter, defaultdict

from tokenfold.llm import url_filters as uf


def plain_templates(pages):
    """Templates by walking every level of every path; pages: list of (host, path)."""
    parts = {(h, p): p[1:].split("/") if p.startswith("/") else [] for h, p in pages}
    template = {key: "" for key in parts}
    for level in range(max(map(len, parts.values()))):
        kids = defaultdict(Counter)
        for h, p in pages:
            if len(parts[h, p]) > level:
                kids[h, template[h, p]][parts[h, p][level]] += 1
        grown = {}
        for (h, p), held in parts.items():
            grown[h, p] = template[h, p]
            if len(held) > level:
                own = kids[h, template[h, p]]
                wild = len(own) > uf.MAX_CHILDREN and sum(own.values()) < uf.MAX_REPEATS * len(own)
                grown[h, p] += "/" + (re.sub(r"^[^.]+", "*", held[level]) if wild else held[level])
        template = grown
    return template


def plain_purity(template, label):
    """Purity of every (host, template); label: list of (host, path, verdict or None), a row a page."""
    bad, labels = Counter(), Counter()
    for h, p, v in label:
        key = h, template[h, p]
        bad[key] += v == "block"
        labels[key] += v is not None
    merged = {key: key[1] for key in labels}
    for level in reversed(range(max(t.count("/") for _, t in merged))):
        b, n, shape = Counter(), Counter(), {}
        for (h, t), m in merged.items():
            held = m.split("/")
            if len(held) > level + 1:
                held[level + 1] = re.sub(r"^[^*]+", "{}", held[level + 1])
            shape[h, m] = "/".join(held)
            b[h, m] += bad[h, t]
            n[h, m] += labels[h, t]
        every_b, every_n = Counter(), Counter()
        for (h, m), s in shape.items():
            every_b[h, s] += b[h, m]
            every_n[h, s] += n[h, m]
        for (h, t), m in list(merged.items()):
            s = shape[h, m]
            if every_n[h, s]:
                share = every_b[h, s] / every_n[h, s]
                own = n[h, m]
                if not own or abs(b[h, m] / own - share) <= uf.SIMILAR * math.sqrt(share * (1 - share) / own) + 1e-9:
                    merged[h, t] = s
    b, n, found = Counter(), Counter(), {}
    for (h, t), m in merged.items():
        b[h, m] += bad[h, t]
        n[h, m] += labels[h, t]
    for (h, t), m in merged.items():
        taken = b[h, m], n[h, m]
        above = t.split("/")
        while not n[h, m] and above:
            under = [k for k in labels if k[0] == h and labels[k] and (k[1].split("/") + [None])[: len(above)] == above]
            if len(under) >= uf.MIN_LABELLED:
                taken = sum(bad[k] for k in under), sum(labels[k] for k in under)
                break
            above.pop()
        found[h, t] = (taken[0] + uf.PRIOR * uf.PRIOR_WEIGHT) / (taken[1] + uf.PRIOR_WEIGHT)
    return found


def test_tree_against_a_plain_one(spark):
    chance = random.Random(11)
    rules = tuple(uf.Rule(v, h, p) for v, h, p in [("block", "one", "/a/"), ("allow", "one", "/b/x"), ("block", "two", "/c/d/e/f/g/1"), ("allow", "two", "/c/d/e/f/h/")])
    urls = []
    for k in range(900):
        host = chance.choice(["one", "two", "three"])
        kind = chance.randrange(5)
        if kind == 0:
            path = f"/{chance.choice('abz')}/{chance.choice('xy')}{chance.randrange(60)}{chance.choice(['', '.html'])}"
        elif kind == 1:
            path = f"/c/d/e/f/{chance.choice('ghi')}/{chance.randrange(200)}/{chance.randrange(30)}/end"
        elif kind == 2:
            path = "/" + "/".join(chance.choice("pq") for _ in range(chance.randrange(9)))
        elif kind == 3:
            path = chance.choice(["", "/", "//", "/a//b", "/*/x", "/{}/x"])
        else:
            path = f"/u{chance.randrange(40)}/post/{chance.randrange(4)}"
        urls.append(f"http://{host}{path}?{k}")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in uf.judge(pages, rules).collect()}
    assert len(got) == len(urls)
    split = {k: re.match(r"http://([^/?]*)([^?]*)", u).groups() for k, u in enumerate(urls)}
    assert {k: (r.host, r.path) for k, r in got.items()} == split

    def judged(host, path):
        fits = [r for r in rules if host == r.host and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)).verdict if fits else None

    template = plain_templates(list(split.values()))
    purity = plain_purity(template, [(h, p, judged(h, p)) for h, p in split.values()])
    for k, (h, p) in split.items():
        assert got[k].template == template[h, p], (h, p)
        assert abs(got[k].purity - purity[h, template[h, p]]) < 1e-9, (h, p, template[h, p])
        assert got[k].verdict == (judged(h, p) or ("block" if purity[h, template[h, p]] >= uf.REJECT else "allow"))
    assert max(t.count("/") for t in template.values()) > 6
    assert sum(r.rule is None and r.verdict == "block" for r in got.values()) > 0


def test_a_very_deep_path(spark):
    deep = "/s" * 3000
    urls = [f"http://h{deep}", f"http://h{deep}/t", f"http://h{deep}", "http://h/s"]
    rows = uf.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert sorted((r.page_id, r.template) for r in rows) == [(0, deep), (1, deep + "/t"), (2, deep), (3, "/s")]
