"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, less the farther away; a container's points
are discounted by the share of its text that stands in links. The container with most points is kept, with those
siblings that score well or are paragraphs of prose. What is marked as no part of the article (menus, forms,
notices, adverts, reader comments and the like) goes before.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from dqwatch.llm.common import map_columns, read

#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style textarea title iframe noembed noframes head nav footer aside noscript template svg math canvas "
    "button select option datalist input label fieldset menu dialog object embed audio video map".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr ruby rt rp".split()
)
PARAGRAPHS = frozenset("p pre td blockquote dd dt li figcaption".split())
KEPT_BESIDE = frozenset("h1 h2 h3 h4 h5 h6 hgroup pre blockquote".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id or role that mark what is no part of an article.
_UNLIKELY = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?(?:list|form|area)?|respond|replies|disqus|cookies?|consent|gdpr|notice|"
    r"alert|footer|header|masthead|menu|nav\w*|newsletter|subscribe|subscription|paywall|pager|pagination|popup|modal|"
    r"overlay|promo\w*|related|recommend\w*|share|sharing|sidebar|side|skip|social|sponsor\w*|toolbar|widget|login|"
    r"signup|search|complementary|contentinfo|navigation|dialog|hidden|sr-only)",
    re.I,
)
#: Parts of a class that say no more than where or what kind of box it is, as in site-footer or comment-list.
_PLAIN_PART = re.compile(
    r"\d+(?:x\d+)?|slot|unit|site|page|global|top|bottom|left|right|primary|secondary|main|inner|outer|posts?|entry|article|blog|users?|readers?|list|item|items|box|"
    r"area|section|container|wrapper|wrap|block|bar|links?|buttons?|icons?|form|menu|thread|reply|body|content|panel|row|group|text",
    re.I,
)
_LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?=$|[\s_-])", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    # a quotation mark quotes behind an equals sign only
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*(?:"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_BREAK = "\n"


class Node:
    __slots__ = ("tag", "marks", "parent", "inside", "score", "dropped")

    def __init__(self, tag: str, marks: dict[str, str], parent: Node | None) -> None:
        self.tag, self.marks, self.parent = tag, marks, parent
        self.inside: list[Node | str] = []
        self.score = 0.0
        self.dropped = parent is not None and _is_dropped(tag, marks, parent)


def _is_dropped(tag: str, marks: dict[str, str], parent: Node) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body"):
        return False
    if tag == "header":  # the heading of an article belongs to it, the head of a page does not
        at: Node | None = parent
        while at is not None and at.tag not in ("article", "main"):
            at = at.parent
        if at is None:
            return True
    if "hidden" in marks or marks.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", marks.get("style", ""), re.I):
        return True
    named = " ".join(marks.get(k, "") for k in ("class", "id", "role"))
    if not any(map(_is_unlikely, named.split())):
        return False
    return not (tag in ("article", "main") and _LIKELY.search(named))


def _is_unlikely(token: str) -> bool:
    """Whether a whole class says so: has-sidebar, overflow-hidden or comments-open speak of something else."""
    if _UNLIKELY.fullmatch(token):
        return True
    parts = [x for x in re.split(r"[_-]+", token) if x]
    named = [x for x in parts if _UNLIKELY.fullmatch(x)]
    return bool(named) and all(_UNLIKELY.fullmatch(x) or _PLAIN_PART.fullmatch(x) for x in parts)


def parse(html: str) -> Node:
    """The element tree; end tags that HTML lets out are put in, unknown ends are skipped."""
    root = Node("#root", {}, None)
    at, now = 0, root
    opened: Counter[str] = Counter()  # elements around ``now`` by their tag

    def leave(node: Node) -> Node:
        """Closes all elements within ``node``'s children up to it."""
        up = now
        while up is not node:
            opened[up.tag] -= 1
            up = up.parent
        return node

    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            now.inside.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                now.inside.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                up = now
                while up.tag != tag:
                    up = up.parent
                now = leave(up.parent)
            continue
        if tag in CLOSES_P and opened["p"]:
            now = leave(_closed(now, {"p"}, {"button", "td", "th", "li", "div", "section", "article", "blockquote"}))
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag][0]):
            now = leave(_closed(now, *CLOSES[tag]))
        marks = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
        node = Node(tag, marks, now)
        now.inside.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|$)|$", re.I | re.S).search(html, at)
            end = end if end[0] else re.compile(r"\Z").search(html, at)
            node.inside.append(html[at : end.start()])
            at = end.end()
        elif tag not in VOID and not m[0].endswith("/>") or tag not in VOID and tag in CLOSES_P | INLINE:
            now = node
            opened[tag] += 1
    if at < len(html):
        now.inside.append(unescape(html[at:]))
    return root


def _closed(now: Node, tags: set[str], limits: set[str]) -> Node:
    up: Node | None = now
    while up is not None and up.tag not in limits:
        if up.tag in tags and up.parent is not None:
            return up.parent
        up = up.parent
    return now


def _kept(root: Node) -> list[Node]:
    """Nodes that weren't dropped, parents first."""
    out, ahead = [], [root]
    while ahead:
        node = ahead.pop()
        out.append(node)
        ahead += [x for x in reversed(node.inside) if isinstance(x, Node) and not x.dropped]
    return out


def _text(node: Node) -> str:
    """Text of a node; block ends and line breaks become line feeds, other white space is as it was."""
    parts: list[str] = []
    ahead: list[Node | str] = [node]
    while ahead:
        x = ahead.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x.dropped:
            continue
        if x.tag == "br" or x.tag not in INLINE:
            parts.append(_BREAK)
            ahead.append(_BREAK)
        ahead += reversed(x.inside)
    return "".join(parts)


def _sizes(nodes: list[Node]) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
    """Characters of text, those within links, and commas under each node; ``nodes`` has parents first."""
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    commas: dict[int, int] = {}
    for node in reversed(nodes):
        own = found = within = 0
        for x in node.inside:
            if isinstance(x, str):
                own += len(x.strip())
                found += x.count(",") + x.count("、") + x.count("，")
            else:
                own += size.get(id(x), 0)
                found += commas.get(id(x), 0)
                within += linked.get(id(x), 0)
        size[id(node)], commas[id(node)] = own, found
        linked[id(node)] = own if node.tag == "a" else within
    return size, linked, commas


def _drop_forms(root: Node) -> list[Node]:
    """Nodes without forms; a form around half of the page's text or more is its frame and stays, without its controls."""
    nodes = _kept(root)
    forms = [n for n in nodes if n.tag == "form"]
    if not forms:
        return nodes
    size, _, _ = _sizes(nodes)
    for form in forms:
        form.dropped = 2 * size[id(form)] < size[id(root)]
    return _kept(root)


def _is_paragraph(node: Node) -> bool:
    """A paragraph, or another block that holds text but no blocks."""
    if node.tag in PARAGRAPHS:
        return True
    if node.tag in INLINE or node.tag in ("#root", "html"):
        return False
    blocks = any(isinstance(x, Node) and x.tag not in INLINE and x.tag != "br" for x in node.inside)
    return not blocks and any(isinstance(x, str) and x.strip() for x in node.inside) and node.tag[:1] != "h"


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, white space as single spaces; empty if there is none. Null is empty."""
    root = parse(html or "")
    nodes = _drop_forms(root)
    size, linked, commas = _sizes(nodes)
    density = lambda n: linked[id(n)] / size[id(n)] if size[id(n)] else 0.0
    given: dict[int, float] = {}  # what a paragraph gives its container
    for node in nodes:
        if _is_paragraph(node) and size[id(node)]:
            to = node.parent if node.tag in PARAGRAPHS else node
            points = (1 + commas[id(node)] + min(size[id(node)] / 100, 3)) * (1 - density(node))
            given[id(to)] = given.get(id(to), 0.0) + points
    candidates = []
    for node in reversed(nodes):  # a container passes half of its points on
        node.score += given.get(id(node), 0.0)
        if node.score > 0 and node.tag not in ("#root", "html"):
            candidates.append(node)
            node.parent.score += node.score / 2
    candidates.reverse()
    for node in candidates:
        if node.tag in ("article", "main") or node.marks.get("role") in ("article", "main"):
            node.score += 25  # the page says itself where its article is
        elif _LIKELY.search(" ".join(node.marks.get(k, "") for k in ("class", "id"))):
            node.score += 5
        node.score *= 1 - density(node)
    named = [n for n in nodes if n.tag in ("article", "main") and size[id(n)]]
    best = max(candidates, key=lambda n: n.score, default=None)
    if best is None:
        best = named[0] if named else next((n for n in nodes if n.tag == "body"), root)
    chosen: list[Node | str] = [best]
    if best.parent is not None and best.tag not in ("body", "#root"):
        marked = best.tag in ("article", "main") or best.marks.get("role") in ("article", "main")
        enough = max(10.0, best.score * 0.2)

        def belongs(x: Node | str) -> bool:
            if isinstance(x, str):
                return not marked
            if x is best or x.dropped:
                return x is best
            if marked:  # the page says itself where its article is
                return x.score >= enough or x.tag == "p" and size.get(id(x), 0) > 80 and density(x) < 0.25
            return x.tag in KEPT_BESIDE or x.score >= enough or density(x) < 0.25

        chosen = [x for x in best.parent.inside if belongs(x)]
    # blocks bring their own breaks, inline pieces stay joined
    return " ".join("".join(x if isinstance(x, str) else _text(x) for x in chosen).split())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html); null ids and urls stay null, repeated rows repeat.

    A null or empty page has an empty text, an empty table gives an empty one, other columns are neither read nor returned.
    A page of n tags takes time in proportion to n, however deep they are nested.
    """

    def run(ids: list, urls: list, htmls: list) -> tuple[list, ...]:
        texts = [main_text(h) for h in htmls]
        return ids, urls, texts, [len(t) for t in texts]

    return map_columns(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))
