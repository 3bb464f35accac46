"""Main text of web pages by tree scoring.

A page becomes a tree of elements.  Each paragraph earns points for its length
and its commas and passes them to its ancestors, discounted by distance; a
container's points are discounted by the share of its text inside links.  The
best container is kept with all that stands beside it and isn't mostly links or
another story, up to the container that holds the headline; menus, adverts,
notices, forms and comments have been taken out before.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, table

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
DROPPED = frozenset("nav footer aside form menu button select option dialog svg canvas object video audio head script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
OWN_KIND = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
PARAGRAPH = frozenset("p pre td li blockquote h1 h2 h3 h4 h5 h6 dd dt figcaption".split())

# Words in class, id and role that mark what isn't the article, and what may be.
UNLIKELY = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs colophon comment comments consent cookie cookies copyright disqus discussion footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split())
UNLIKELY_STARTS = ("advert", "breadcrumb", "comment", "cookie", "navbar", "navigat", "newsletter", "sidebar")
#: Those that also hold for an article element, and for what holds one.
NO_ARTICLE = frozenset("ad ads comment comments disqus promo related replies reply sponsored teaser".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LIKELY = frozenset("article body content entry hentry main page post story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</\s*([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "by_name", "firm", "points", "chars", "link_chars", "hint", "heads", "stories", "headed", "other")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "", in_section: bool = False):
        self.tag, self.parent, self.parts = tag, parent, []
        self.points, self.chars, self.link_chars, self.hint = 0.0, 0, 0, 0
        self.heads, self.stories = 0, 0  # kept headlines (h1) and articles in it
        self.headed = self.other = False  # whether its first text is in a heading; whether it holds an article with a heading of its own
        self.dropped = tag in DROPPED
        self.by_name = self.firm = False
        if tag == "header":  # a page's header, not an article's
            self.dropped = not in_section
        if attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            names = {w.lower() for k in ("class", "id", "role") for w in _WORD.findall(found.get(k, ""))}
            self.hint = 25 * bool(names & LIKELY)
            self.firm = bool(names & NO_ARTICLE)
            if tag in ("article", "main"):
                self.dropped = self.firm
            elif tag not in ("html", "body") and not self.dropped:
                self.by_name = bool(names & UNLIKELY) or any(n.startswith(UNLIKELY_STARTS) for n in names)
                self.dropped = self.by_name or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")


class _Open:
    """The open elements, with the places of each tag and of block elements among them, so that no search walks through a deep page."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element with one of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()


def parse(html: str) -> Node:
    """The tree of a page.  Unclosed and stray tags are mended as browsers do: block tags end an open paragraph, end tags close what lies inside."""
    root = Node("html", None)
    open_ = _Open(root)
    at, low = 0, None
    while at < len(html):
        m = _TOKEN.search(html, at)
        here = open_.nodes[-1]
        if m is None:
            here.parts.append(html[at:])
            break
        if m.start() > at:
            here.parts.append(html[at : m.start()])
        at = m.end()
        if m[1]:  # an end tag
            if place := open_.last(m[1].lower()):
                open_.close(place)
        elif m[2]:
            tag = m[2].lower()
            if tag in ("html", "body"):
                continue
            if tag in CLOSES_P and open_.blocks and open_.nodes[open_.blocks[-1]].tag == "p":
                open_.close(open_.blocks[-1])
            if tag in OWN_KIND and (place := open_.last(tag)) > open_.last(*OWN_KIND[tag]):
                open_.close(place)
            here = open_.nodes[-1]
            node = Node(tag, here, m[3], tag == "header" and bool(open_.last("article", "main", "section")))
            here.parts.append(node)
            if tag in RAW:
                low = html.lower() if low is None else low
                end = low.find(f"</{tag}", at)
                at = len(html) if end < 0 else end
                open_.push(node)
            elif tag not in VOID:
                open_.push(node)
    return root


def _spare(root: Node) -> None:
    """Takes back a drop by name where it would take the story: a frame named after its sidebar, say, that holds the page's only article, or the heading and half of all text.

    An article inside comments, adverts or teasers is none of the page's own.

    Where nothing would be left, it is taken back for elements whose names speak of a story too.
    """
    if not any(isinstance(c, Node) for c in root.parts):
        return
    order, stack, clear = [], [(root, False, False)], False
    while stack:
        node, hidden, within = stack.pop()
        order.append(node)
        hidden, within = hidden or node.dropped, within or node.tag in ("article", "main")
        clear = clear or within and not hidden and any(isinstance(p, str) and p.strip() for p in node.parts)
        stack += [(c, hidden, within) for c in node.parts if isinstance(c, Node)]
    if not any(n.by_name for n in order):
        return
    size: dict[int, int] = {}
    story: dict[int, bool] = {}
    heading: dict[int, bool] = {}
    for node in reversed(order):
        inside = [c for c in node.parts if isinstance(c, Node) and (c.by_name or not c.dropped)]
        size[id(node)] = sum(len(p.strip()) for p in node.parts if isinstance(p, str)) + sum(size[id(c)] for c in inside)
        story[id(node)] = not clear and not node.firm and (node.tag in ("article", "main") or any(story[id(c)] for c in inside))
        heading[id(node)] = node.tag == "h1" or any(heading[id(c)] for c in inside)
    for node in order:
        if node.by_name and (story[id(node)] or heading[id(node)] and 2 * size[id(node)] >= size[id(root)]):
            node.dropped = False
    left: dict[int, int] = {}
    for node in reversed(order):
        left[id(node)] = 0 if node.dropped else sum(len(p.strip()) for p in node.parts if isinstance(p, str)) + sum(left[id(c)] for c in node.parts if isinstance(c, Node))
    if not left[id(root)]:
        for node in order:
            node.dropped = node.dropped and not (node.by_name and node.hint)


def _measure(root: Node) -> list[Node]:
    """Sums characters bottom-up and scores paragraphs; returns all kept elements in page order.

    A paragraph's points go to its parent, half of them to the next ancestor,
    and so on, halved at each step.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        if node.dropped:
            continue
        order.append((node, link or node.tag == "a"))
        stack += [(c, link or node.tag == "a") for c in reversed(node.parts) if isinstance(c, Node)]
    own: dict[int, list] = {}
    for node, link in reversed(order):  # a node's points are complete when its turn comes
        text = "".join(p for p in node.parts if isinstance(p, str))
        n, commas = len(text.strip()), text.count(",") + text.count("，") + text.count("、")
        for c in node.parts:
            if isinstance(c, Node) and not c.dropped:
                node.link_chars += c.link_chars
                node.chars += c.chars
                node.heads += c.heads
                node.stories += c.stories
                if c.tag not in BLOCK:
                    n, commas = n + own[id(c)][0], commas + own[id(c)][1]
        mine = len(text.strip())
        node.chars += mine
        node.heads += node.tag == "h1" and node.chars > 0
        node.stories += node.tag == "article" and node.chars > 0
        said = next((p for p in node.parts if (p.strip() if isinstance(p, str) else not p.dropped and p.chars)), None)
        node.headed = said is not None and (node.tag in HEADINGS or isinstance(said, Node) and said.headed)
        node.other = node.tag == "article" and node.headed or any(c.other for c in node.parts if isinstance(c, Node) and not c.dropped)
        node.link_chars += mine if link else 0
        own[id(node)] = [n, commas]
        passed = node.points / 2
        if n >= 25 and (node.tag in PARAGRAPH or node.tag in BLOCK):
            density = node.link_chars / max(node.chars, 1)
            passed += (1 + commas + min(n / 100, 3)) * (1 - density)
        if node.parent is not None:
            node.parent.points += passed
    return [node for node, _ in order]


def _score(node: Node) -> float:
    bonus = node.hint + (25 if node.tag in ("article", "main") else 5 if node.tag in ("div", "section") else 0)
    return (node.points + (bonus if node.points or node.tag in ("article", "main") else 0)) * (1 - node.link_chars / max(node.chars, 1))


def _blocks(node: Node, out: list[str]) -> None:
    """Appends the texts of a subtree's blocks in page order."""
    open_: list[str] = []

    def flush():
        text = _SPACE.sub(" ", unescape("".join(open_))).strip()
        if text:
            out.append(text)
        open_.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            open_.append(x)
        elif x is None:
            flush()
        elif not x.dropped:
            if x.tag == "br":
                open_.append(" ")
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.parts)
    flush()


def _linked(node: Node) -> bool:
    """Whether at least half of a node's text is inside links."""
    return node.chars > 0 and 2 * node.link_chars >= node.chars


def _run(best: Node) -> list[Node]:
    """The articles side by side that make one story with ``best``: a heading begins a story, an article without one continues the story before it."""
    runs: list[list[Node]] = [[]]
    for c in best.parent.parts if best.parent is not None else [best]:
        if isinstance(c, Node) and c.tag == "article" and not c.dropped and (c is best or not _linked(c)):
            if c.headed and runs[-1]:
                runs.append([])
            runs[-1].append(c)
    return next(r for r in runs if any(c is best for c in r))


def _beside(parent: Node, held: dict[int, Node], articles: bool, before: bool) -> list[Node | str]:
    """The parts of ``parent`` with those in ``held`` replaced, without those mostly inside links and other stories; bare text and inline elements between blocks count as one.

    With ``articles`` the story is one of articles, so any other article is
    another story.  With ``before`` only what stands from the headline to the
    last of ``held`` is kept.
    """
    kept: list[Node | str] = []
    run: list[Node | str] = []

    def close():
        whole = Node("p", None)
        for x in run:
            if isinstance(x, str):
                whole.chars += len(x.strip())
            elif not x.dropped:
                whole.chars += x.chars
                whole.link_chars += x.link_chars
        if not _linked(whole):
            kept.extend(run)
        run.clear()

    last = max(i for i, c in enumerate(parent.parts) if id(c) in held)
    begin = next((i for i, c in enumerate(parent.parts) if isinstance(c, Node) and not c.dropped and c.heads), len(parent.parts))
    for i, c in enumerate(parent.parts):
        if id(c) in held:
            close()
            kept.append(held[id(c)])
        elif before and not begin <= i <= last:
            continue
        elif isinstance(c, str) or c.tag not in BLOCK:
            run.append(c)
        elif not c.dropped:
            close()
            if c.tag == "h1" or not _linked(c) and not (c.stories if articles else c.other):  # a headline may link to its own page
                kept.append(c)
    close()
    return kept


def _story(best: Node) -> Node:
    """``best`` with what belongs to its story: what stands beside it, all of the article around it, and the way up to the headline.

    Of the page's own top level only what stands from the headline to the story
    is taken, and only if the story doesn't begin with a heading.
    """
    articles = best.tag == "article"
    held = {id(c): c for c in (_run(best) if articles else [best])}
    heads = sum(c.heads for c in held.values())
    within, above = [], best.parent  # the ancestors up to the one to climb to
    first = best.tag not in ("article", "main")
    goal = 1 if first else 0
    while above is not None:
        within.append(above)
        if above.tag == "article":
            goal = len(within)
        if above.heads and not heads:
            heads = above.heads
            if above.parent is not None or not any(c.headed for c in held.values()):
                goal = len(within)
        above = above.parent
    whole = best
    for n, parent in enumerate(within[:goal]):
        whole = Node("div", None)
        whole.parts = _beside(parent, held, articles, parent.parent is None and (n > 0 or not first))
        held = {id(parent): whole}
    if not goal and articles:
        whole = Node("div", None)
        whole.parts = list(held.values())
    return whole


def main_text(html: str | None) -> str:
    """The article of a page as blocks joined by newlines; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    _spare(root)
    nodes = _measure(root)
    holders = [n for n in nodes if n.tag in BLOCK and n.tag not in PARAGRAPH and n.chars]
    if not holders:
        return ""
    best = max(holders, key=_score)  # ties: the first in the page
    if best.stories and best.tag != "article":  # several stories and one that has most of the text or the headline: that one
        at, inside = [best], best
        while at:
            x = at.pop()
            if x.tag == "article" and x.chars > (inside.chars if inside is not best else 0):
                inside = x
            at += [c for c in reversed(x.parts) if isinstance(c, Node) and not c.dropped and c.stories]
        if inside.headed and (2 * inside.chars > best.chars or inside.heads and inside.heads == best.heads):
            best = inside
    out: list[str] = []
    _blocks(_story(best), out)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of the whole html of each page.

    Null and empty html give an empty text; repeated rows give repeated rows;
    other columns aren't read.  Of containers with equal scores the first in
    the page is taken.  Pages of any length are parsed whole, in time linear
    in their length.
    """

    def make():
        def work(cols):
            texts = [main_text(h) for h in cols["html"]]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_slices(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), make, "page_id long, url string, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
