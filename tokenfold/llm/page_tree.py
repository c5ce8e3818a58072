"""One page's block tree: tokens of HTML to nodes, text runs and what their names say.

Only block elements are nodes; text between two block borders is a leaf of its own. Nodes come in
page order, so a parent's number is below its children's, and every walk is a loop over arrays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import xxhash

#: HTML's element names by behaviour (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main map menu nav noscript object ol optgroup option p pre search section select "
    "summary svg table tbody td template tfoot th thead tr ul video audio math".split()
)
#: What an opening tag closes, and the elements within which it does so (fixed values of HTML's parsing rules, shortened).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tr", "td", "th"}, {"table"}),
}

#: Elements, ARIA roles and words of class and id that never hold an article's own text.
NOISE_TAGS = frozenset("nav footer aside form dialog menu noscript template svg math select button object canvas video audio fieldset search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NOISE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead "
    "sidebar sidenav aside cookie cookies consent gdpr notice notices notification disclaimer popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended recommendations trending comment comments disqus respond reply replies feedback widget widgets toolbar pagination pager copyright skip".split()
)
#: A header is noise outside of an article only.
HEADER_WORDS = frozenset(["header", "topbar"])
CONTENT_WORDS = frozenset("article main content post entry story body text".split())
NEVER_JUDGED = frozenset("article main h1 h2 h3 h4 h5 h6 #".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

#: What a node's own names say of it.
PLAIN, NOISE, HEADER, CONTENT = 0, 1, 2, 3


@dataclass
class Page:
    """Nodes in page order. ``label`` is a node's presentation; ``text`` and ``linked`` (characters in links,
    links) are of leaves."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    says: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[tuple[int, int]] = field(default_factory=list)

    def add(self, tag: str, parent: int, label: str, says: int, text: str = "", linked: tuple[int, int] = (0, 0)) -> int:
        for held, value in zip((self.tag, self.parent, self.label, self.says, self.text, self.linked), (tag, parent, label, says, text, linked)):
            held.append(value)
        return len(self.tag) - 1


@lru_cache(maxsize=4096)
def _named(tag: str, attributes: str) -> tuple[str, int]:
    """A node's presentation (its tag, class, id and role without digits, and whether it is hidden) and what its names say."""
    held = {}
    for m in _ATTRIBUTE.finditer(attributes):
        held.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = " ".join(filter(None, (held.get("class"), held.get("id"))))
    role = held.get("role", "").lower()
    label = f"{tag}.{_DIGITS.sub('', names)}.{role}" if names or role else tag
    words = {w.lower() for w in _WORD.findall(names)}
    unseen = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
    label += "!" * unseen
    if unseen or tag in NOISE_TAGS or role in NOISE_ROLES or (tag not in NEVER_JUDGED or tag == "article") and words & NOISE_WORDS:
        return label, NOISE
    if tag == "header" or words & HEADER_WORDS and tag not in NEVER_JUDGED:
        return label, HEADER
    return label, CONTENT if tag in ("article", "main") or role == "main" or words & CONTENT_WORDS else PLAIN


def parse(html: str) -> Page:
    """The block tree of a page; node 0 is the page. Anything is read as some tree, however broken."""
    page = Page()
    page.add("page", -1, "page", PLAIN)
    stack, count = [0], {}
    pieces, at, size = [], 0, len(html)
    in_link, link_chars, links = False, 0, 0

    def flush() -> None:
        nonlocal link_chars, links
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                page.add("#", stack[-1], "#", PLAIN, text, (link_chars, links))
            pieces.clear()
        link_chars = links = 0

    def close(names: set[str], within: set[str] | frozenset = frozenset()) -> None:
        """Close the innermost of ``names`` with all in it, unless one of ``within`` is met first."""
        if not any(count.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[depth]]
            if tag in names:
                flush()
                for node in stack[depth:]:
                    count[page.tag[node]] -= 1
                del stack[depth:]
                return
            if tag in within:
                return

    while at < size:
        m = _TAG.search(html, at)
        end = m.start() if m else size
        if end > at:
            piece = html[at:end]
            pieces.append(piece)
            if in_link:
                link_chars += len(piece.strip())
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing:
                found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = found.end() if found else size
        elif closing:
            if tag in BLOCKS:
                close({tag})
                flush()
                in_link = False
            elif tag == "a":
                in_link = False
        elif tag in BLOCKS:
            flush()
            in_link = False
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag != "option":
                close({"p"}, {"td", "th", "button", "object", "caption"})
            if tag not in VOID:
                label, says = _named(tag, attributes)
                stack.append(page.add(tag, stack[-1], label, says))
                count[tag] = count.get(tag, 0) + 1
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link, links = True, links + 1
    flush()
    return page


def ruled_out(page: Page) -> list[bool]:
    """Of every node whether its names or those around it rule it out; headers count outside of articles only.

    This follows from the presentations on the way to the node, so pages that share a node agree in it.
    """
    dead, article = [False] * len(page.tag), [False] * len(page.tag)
    for node in range(1, len(page.tag)):
        up = page.parent[node]
        article[node] = article[up] or page.tag[node] in ("article", "main")
        dead[node] = dead[up] or page.says[node] == NOISE or (page.says[node] == HEADER and not article[node])
    return dead


def identities(page: Page, host: str) -> tuple[list[int], list[int]]:
    """Per node its identity in the site's style tree, and its variant there.

    A node is known by its parent, its parent's style (the presentations of all its children) and its
    place among them; nodes of different pages that agree in these are one. Its variant is its own style,
    that of a leaf its text. Identities are signed 64-bit hashes.
    """
    n = len(page.tag)
    kids: list[list[int]] = [[] for _ in range(n)]
    for node in range(1, n):
        kids[page.parent[node]].append(node)
    known, variant = [0] * n, [0] * n
    known[0] = xxhash.xxh64_intdigest(host)
    for node in range(n):
        own = known[node].to_bytes(8, "little")
        if page.tag[node] == "#":
            variant[node] = xxhash.xxh64_intdigest(page.text[node])
            continue
        style = xxhash.xxh64_intdigest(own + "\n".join(page.label[k] for k in kids[node]).encode("utf-8", "surrogatepass"))
        variant[node] = style
        base = style.to_bytes(8, "little")
        for place, kid in enumerate(kids[node]):
            known[kid] = xxhash.xxh64_intdigest(base + place.to_bytes(8, "little"))

    def signed(values: list[int]) -> list[int]:
        return [v - (1 << 64) if v >> 63 else v for v in values]

    return signed(known), signed(variant)
