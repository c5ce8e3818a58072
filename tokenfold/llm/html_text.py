"""Main text of web pages by a style tree per site.

Pages of a host are merged into one tree of presentation: a node is known by its parent, the parent's
style (how all its children look) and its place there. The importance of an inner node is the entropy
of its styles over the pages that have it, that of a text leaf how little of its texts is shared by
those pages. Composite importance sums both upwards, the share of what lies below growing with the
number of styles. A page then loses its branches of low importance, along with those whose element,
role or name is never an article's own.

The tree is never built in one place: its nodes are keys of a count. Only nodes of two pages or more
have a record, as all others have importance 1 by definition. They are joined to the pages' nodes,
and a page sums up its own branches in one task; the number of jobs doesn't depend on depth.
"""

from __future__ import annotations


import json
import zlib
from dataclasses import astuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenfold.llm.common import releasing, written
from tokenfold.llm.page_tree import CONTENT, NEVER_JUDGED, Page, identities, parse, ruled_out

#: Composite importance under which a branch goes, and how fast the weight of what lies below falls with the number of styles.
THRESHOLD, DECAY = 0.3, 0.9

#: Pages that must have a node before it is judged.
SUPPORT = 3

#: Within an article a branch goes only if it holds less than this share of the article's text.
MINOR = 1 / 3

#: Outside of an article, a branch whose text lies in links to this share, in two links or more, is a menu.
LINKED = 0.8

#: Pages of a batch that goes to Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


def host_of(url: str | None) -> str:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; empty without one."""
    rest = (url or "").partition("://")[2]
    for mark in "/?#":
        rest = rest.partition(mark)[0]
    return rest.lower()


def composite(page: Page, dead: list[bool], known: dict[int, tuple[float, float]]) -> list[float]:
    """Composite importance of every node. ``known`` has, of nodes on several pages, own importance and the weight of what is below.

    A node that only this page has, and all below it, has importance 1. What is ruled out doesn't count.
    """
    n = len(page.tag)
    out, total, kids = [1.0] * n, [0.0] * n, [0] * n
    for node in range(n - 1, -1, -1):
        if node in known:
            own, below = known[node]
            out[node] = (1 - below) * own + below * total[node] / kids[node] if kids[node] else own
        if node and not dead[node]:
            total[page.parent[node]] += out[node]
            kids[page.parent[node]] += 1
    return out


def _roots(page: Page, dead: list[bool]) -> list[int]:
    """The outermost articles, else main elements, else nodes named as content; none if a page has no such node."""
    for fits in (lambda n: page.tag[n] == "article", lambda n: page.tag[n] == "main" or page.label[n].endswith(".main"), lambda n: page.says[n] == CONTENT):
        found, inside = [], [False] * len(page.tag)
        for node in range(1, len(page.tag)):
            up = page.parent[node]
            inside[node] = inside[up] or (not dead[node] and fits(node))
            if inside[node] and not inside[up]:
                found.append(node)
        if found:
            return found
    return []


def candidates(page: Page, dead: list[bool], roots: list[int]) -> list[bool]:
    """The nodes whose text may be the page's: within an article, if there is one, and not ruled out."""
    within = [not roots] * len(page.tag)
    for node in roots:
        within[node] = True
    for node in range(1, len(page.tag)):
        within[node] = (within[node] or within[page.parent[node]]) and not dead[node]
    return within


def _judged(page: Page, node: int, roots: list[int]) -> bool:
    """Whether a node may go by its importance: within an article no headings, paragraphs or bare text."""
    return not roots or page.tag[node] not in NEVER_JUDGED and page.tag[node] != "p" and node not in roots


def main_blocks(page: Page, dead: list[bool], roots: list[int], importance: list[float]) -> list[str]:
    """The texts of the blocks that stay, in page order."""
    n, stays = len(page.tag), candidates(page, dead, roots)
    best = max((importance[k] for k in range(n) if page.tag[k] == "#" and stays[k]), default=1.0)
    # Judged against the page's most important text, so that a page all of which others share keeps it.
    bar = min(THRESHOLD, best / 2)
    chars, linked, links = [0] * n, [0] * n, [0] * n
    for node in range(n - 1, 0, -1):
        if not dead[node]:
            if page.tag[node] == "#":
                chars[node], (linked[node], links[node]) = len(page.text[node]), page.linked[node]
            up = page.parent[node]
            chars[up] += chars[node]
            linked[up] += linked[node]
            links[up] += links[node]
    top = [0] * n
    for node in roots:
        top[node] = chars[node]
    gone = [False] * n
    for node in range(1, n):
        up = page.parent[node]
        top[node] = top[node] or top[up]
        gone[node] = gone[up]
        if not gone[node] and stays[node] and _judged(page, node, roots):
            low = importance[node] < bar and (not roots or chars[node] < MINOR * top[node])
            menu = not roots and page.tag[node] != "#" and links[node] > 1 and linked[node] >= LINKED * chars[node]
            gone[node] = low or menu
    return [page.text[k] for k in range(n) if page.tag[k] == "#" and stays[k] and not gone[k]]


_NODES = pa.list_(pa.struct([("place", pa.int32()), ("node", pa.int64()), ("variant", pa.int64()), ("leaf", pa.bool_())]))


def _drafted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (page_id, url, html) with their live nodes, and either the blocks or the tree, if its branches are to be judged."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        nodes, blocks, trees = [], [], []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            page = parse(html)
            dead = ruled_out(page)
            roots = _roots(page, dead)
            stays = candidates(page, dead, roots)
            kinds = [tag == "#" for tag in page.tag]
            nodes.append([x for x in zip(range(len(kinds)), *identities(page, host_of(url)), kinds) if not dead[x[0]]])
            due = any(stays[k] and _judged(page, k, roots) for k in range(1, len(kinds)))
            blocks.append(None if due else [page.text[k] for k in range(len(kinds)) if kinds[k] and stays[k]])
            trees.append(zlib.compress(json.dumps(astuple(page)).encode(), 1) if due else None)
        rows = pa.array(range(number, number + batch.num_rows), pa.int64())
        number += batch.num_rows
        listed = pa.array([[dict(zip(("place", "node", "variant", "leaf"), x)) for x in own] for own in nodes], _NODES)
        yield pa.RecordBatch.from_arrays(
            [rows, batch.column(0), batch.column(1), listed, pa.array(blocks, pa.list_(pa.string())), pa.array(trees, pa.binary())], ["row", "page_id", "url", "nodes", "blocks", "tree"]
        )


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees (page_id, url, tree, known) to page_id, url and blocks."""
    for batch in batches:
        out = []
        for tree, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            page = Page(*json.loads(zlib.decompress(tree)))
            dead = ruled_out(page)
            importance = composite(page, dead, {j["place"]: (j["own"], j["below"]) for j in known or ()})
            out.append(main_blocks(page, dead, _roots(page, dead), importance))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["page_id", "url", "blocks"])


def style_tree(nodes: DataFrame) -> DataFrame:
    """Of the merged trees the nodes that at least ``SUPPORT`` pages have: node, pages, styles, own, below.

    ``nodes`` has a row per node of a page: node, variant, leaf. ``own`` is a node's own importance: of an
    inner node the entropy of its styles, of a leaf the mean over its texts of 1 less the entropy of the
    pages that have the text, both to the base of the number of pages. ``below`` is the weight that
    composite importance gives to what lies below a node.
    """
    counted = nodes.groupBy("node", "variant", "leaf").agg(F.count("*").alias("n"))
    sums = counted.groupBy("node").agg(
        F.sum("n").alias("pages"), F.count("*").alias("styles"), F.sum(F.log("n")).alias("logs"), F.sum(F.col("n") * F.log("n")).alias("weighted"), F.max("leaf").alias("leaf")
    )
    base = F.log("pages")
    own = F.when(F.col("leaf"), 1 - F.col("logs") / F.col("styles") / base).otherwise(1 - F.col("weighted") / F.col("pages") / base)
    return sums.filter(F.col("pages") >= SUPPORT).select("node", "pages", "styles", own.alias("own"), F.pow(F.lit(DECAY), "styles").alias("below"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, and blocks, the main text's blocks in order.

    A null html is read as empty and has no blocks; a null url has the empty host. Repeated rows count as
    pages of the site and have equal results. A page of any size or depth is read in one task, in memory of
    its own size. An empty table gives no rows; further columns are ignored.

    The page is parsed once. What its names settle is settled there; only pages with branches to be judged
    keep their tree and are joined with the site's.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    listed = "array<struct<place:int,node:bigint,variant:bigint,leaf:boolean>>"
    drafted = rows.mapInArrow(releasing(_drafted), f"row long, page_id {kind}, url string, nodes {listed}, blocks array<string>, tree binary")
    drafts = written(drafted, "page-drafts", BATCH)
    due = drafts.filter(F.col("tree").isNotNull())
    tree = written(style_tree(drafts.select(F.inline("nodes"))), "style-tree")
    placed = due.select("row", F.inline("nodes")).select("row", "place", "node")
    known = placed.join(tree.select("node", "own", "below"), "node").groupBy("row").agg(F.collect_list(F.struct("place", "own", "below")).alias("known"))
    held = due.select("row", "page_id", "url", "tree").join(known, "row", "left").select("page_id", "url", "tree", "known")
    finished = written(held.mapInArrow(releasing(_finished), f"page_id {kind}, url string, blocks array<string>"), "page-texts", BATCH)
    return drafts.filter(F.col("tree").isNull()).select("page_id", "url", "blocks").unionByName(finished)
