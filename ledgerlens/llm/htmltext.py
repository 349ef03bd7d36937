"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, discounted by the share of text inside links. The best
container and those of its siblings that also hold article text are kept; what lies inside them is read block by block.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import add_columns

# HTML element names by role (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video form fieldset input button select textarea nav footer aside menu dialog".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header "
    "address details summary hgroup center hr".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("html body caption thead tbody tfoot tr td th".split())
# words of class, id and role that name parts of a page other than its article (fixed values)
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notification newsletter "
    "subscribe subscription signup login sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments "
    "commentlist disqus respond reply replies recirc share sharing popup modal overlay lightbox widget widgets pagination "
    "pager tags taglist contentinfo complementary outbrain taboola".split()
)
# words that articles, their sections and wrappers have too: these only count against a part that reads like none (fixed values)
DOUBTFUL = frozenset("discussion related recommended recommendations social follow print skip search alert legal copyright disclaimer".split())
# a class that says that a part of the page is there or is not, as in "no-sidebar" or "content-with-sidebar"
ABOUT = re.compile(r"(?:^|[-_])(?:no|has|with|without|hide|show|is|not)[-_]", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: A paragraph scores for this many of its ancestors.
REACH = 12


class Node:
    __slots__ = ("tag", "parent", "children", "junk", "score", "length", "linked", "commas", "points", "heads", "holds")

    def __init__(self, tag: str, parent: Node | None, junk: int = 0):
        self.tag, self.parent, self.junk = tag, parent, junk
        self.children: list[Node | str] = []
        self.score, self.length, self.linked, self.commas, self.points = 0.0, 0, 0, 0, 0.0
        self.heads, self.holds = 0, 0  # main headings, and article and main elements, inside


NAMED, UNSURE, NEVER = 1, 2, 3


def _junk(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """NEVER for elements that are no text of the page, NAMED or UNSURE by what class, id and role say, 0 for all others."""
    if tag in DROPPED:
        return NEVER
    level = 0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return NEVER
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NEVER
        if name in ("class", "id", "role") and value and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                words = {w.lower() for w in WORDS.findall(token)}
                if words & JUNK and not ABOUT.search(token):
                    level = NAMED
                elif words & DOUBTFUL and level == 0:
                    level = UNSURE
    return level


class Tree(HTMLParser):
    """Builds nodes with the implied ends that pages rely on; unknown or late end tags do no harm."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.open: dict[str, int] = {}

    def _leave(self, parent: Node) -> None:
        """Go up to ``parent``; ``open`` counts the elements that are still open, by tag."""
        n = self.at
        while n is not parent:
            self.open[n.tag] -= 1
            n = n.parent
        self.at = parent

    def _close(self, tags: frozenset[str] | set[str], stop: frozenset[str] | set[str]) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        n = self.at
        while n.parent is not None and n.tag not in stop:
            if n.tag in tags:
                self._leave(n.parent)
                return
            n = n.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P or tag in DROPPED and tag not in ("input", "button", "select", "textarea", "script", "style", "noscript", "template"):
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag == "li":
            self._close({"li"}, {"ul", "ol"})
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, {"dl"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"table"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        elif tag == "option":
            self._close({"option"}, {"select"})
        elif tag == "body":
            self._close({"head"}, set())
        node = Node(tag, self.at, _junk(tag, attrs))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "math"):
            self._leave(self.at.parent)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        n = self.at
        while n.parent is not None and n.tag != tag:
            # an end tag of inline markup doesn't reach out of its block
            if n.tag in BLOCKS and tag not in BLOCKS and tag not in DROPPED:
                return
            n = n.parent
        if n.parent is not None:
            self._leave(n.parent)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _walk(root: Node):
    """Nodes in page order, each after its ancestors; without recursion, so that depth has no limit."""
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


def _drop(root: Node, gone) -> None:
    for n in _walk(root):
        n.children = [c for c in n.children if isinstance(c, str) or not gone(c)]


def _prune(root: Node) -> None:
    """Take out what is no article text, judged by the tree's scores.

    Elements that never hold it go at once. A part that its class, id or role names as something else goes unless it holds an
    article or main element, or most of the page's points: then it is a wrapper. Without the page's main heading it must have
    several paragraphs, and no more than a few points may be left beside it. A doubtful name only counts against a part with little text or many links. A header inside an article stays if it has a heading.
    """
    _drop(root, lambda c: c.junk == NEVER)
    _measure(root)
    inside: dict[int, bool] = {id(root): False}
    for n in _walk(root):  # ancestors first
        for c in n.children:
            if isinstance(c, Node):
                inside[id(c)] = inside[id(n)] or n.tag in ("article", "main")
    _drop(root, lambda c: c.tag == "header" and not (c.heads and inside[id(c)]))
    order = _measure(root)
    _weigh(order)
    total, heads = root.points, root.heads

    def gone(c: Node) -> bool:
        if not c.junk or c.holds:
            return False
        share = c.points / total if total else 0.0
        wrapper = share >= 0.5 and (c.heads > 0 or c.points >= 12 and (not heads or total - c.points < 6))
        if c.junk == NAMED:
            return not wrapper
        return not wrapper and (c.length < 60 or _density(c) >= 0.3 or not heads and not inside[id(c)])

    _drop(root, gone)


def _measure(root: Node) -> list[Node]:
    """Text, linked text, commas and main headings of every node, from the leaves up; nodes in page order."""
    order = list(_walk(root))
    for n in reversed(order):
        own = [x for x in (" ".join(c.split()) for c in n.children if isinstance(c, str)) if x]
        inner = [c for c in n.children if isinstance(c, Node)]
        n.length = sum(map(len, own)) + sum(c.length for c in inner)
        n.commas = sum(x.count(",") + x.count("、") + x.count("，") for x in own) + sum(c.commas for c in inner)
        n.linked = n.length if n.tag == "a" else sum(c.linked for c in inner)
        n.heads = (n.tag == "h1") + sum(c.heads for c in inner)
        n.holds = (n.tag in ("article", "main")) + sum(c.holds for c in inner)
    return order


def _own_points(n: Node) -> float:
    """What a paragraph, or a division with text of its own, is worth."""
    if n.tag in PARAGRAPHS:
        commas, length = n.commas, n.length
    elif n.tag in ("div", "section", "article", "main", "body", "center"):
        own = [x for x in (" ".join(c.split()) for c in n.children if isinstance(c, str)) if x]
        if not own:
            return 0.0
        commas, length = sum(x.count(",") + x.count("、") + x.count("，") for x in own), sum(map(len, own))
    else:
        return 0.0
    return (1 + commas + min(length / 100, 3)) * (1 - _density(n))


def _weigh(order: list[Node]) -> None:
    """The points of all paragraphs in a subtree; those of a paragraph inside a paragraph count once."""
    for n in reversed(order):
        inner = sum(c.points for c in n.children if isinstance(c, Node))
        n.points = max(inner, _own_points(n)) if n.tag in PARAGRAPHS else inner + _own_points(n)


def _density(n: Node) -> float:
    return n.linked / n.length if n.length else 0.0


def _score(order: list[Node]) -> None:
    for n in order:
        points = _own_points(n)
        if points:
            up, level = (n.parent if n.tag in PARAGRAPHS else n), 1.0
            for _ in range(REACH):
                if up is None or up.tag == "#root":
                    break
                up.score += points / level
                up, level = up.parent, level * 2 if level < 2 else level + 2


def _best(root: Node, order: list[Node]) -> list[Node]:
    candidates = [n for n in order if n.score > 0 and n.tag not in ("html", "#root")]
    if not candidates:
        return [n for n in order if n.tag == "body"][:1] or [root]
    top = max(candidates, key=lambda n: n.score * (1 - _density(n)))
    # an article is kept whole, though its best part may be one section
    up = top
    while up is not None:
        if up.tag in ("article", "main"):
            top = up
        up = up.parent
    if top.parent is None or top.tag in ("article", "main", "body"):
        return [top]
    goal = top.score * (1 - _density(top))
    kept = []
    for c in top.parent.children:
        if not isinstance(c, Node):
            continue
        worth = c.score * (1 - _density(c))
        prose = c.tag in PARAGRAPHS | HEADINGS and c.length > 0 and _density(c) < 0.25
        if c is top or worth >= max(10.0, 0.2 * goal) or prose or worth > 0 and _density(c) < 0.25 and c.tag == top.tag:
            kept.append(c)
    return kept


def _blocks(nodes: list[Node]) -> list[str]:
    out, part = [], []

    def end() -> None:
        text = " ".join("".join(part).split())
        if text:
            out.append(text)
        part.clear()

    for root in nodes:
        end()
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                part.append(x)
            elif x.tag in ("br", "img", "wbr"):
                part.append(" " if x.tag == "br" else "")
            elif x.tag in BLOCKS:
                end()
                stack.append(None)
                stack.extend(reversed(x.children))
            else:
                stack.extend(reversed(x.children))
        end()
    return out


def main_text(html: str | None) -> str:
    """The article of one page: blocks in page order, joined by line ends; empty if there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    _prune(tree.root)
    order = _measure(tree.root)
    _score(order)
    return "\n".join(_blocks(_best(tree.root, order)))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row, repeated rows included: a map without a shuffle.

    A null or empty page has an empty text; other columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    found = add_columns(rows, "html", lambda pages: [[main_text(h) for h in pages]], [("text", "string")])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
