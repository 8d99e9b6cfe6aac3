"""Main text of web pages by scoring the tree of their elements.

Elements that are no article text by their tag or role are cut off first, and those with
such a class or id unless they hold the article or most of the page (their points halve).
Paragraphs then pass points (one, one per comma, up to three for length) to their
parent and, thinned, to the ancestors above; a candidate's points shrink by the share
of its text in links. The best container is taken with those siblings that hold a fair
share of its points; up to an enclosing article or main, all but boxes of links stay.

Defined cases: a null or empty page, or one without any text outside boilerplate, gives
an empty text; unclosed and stray tags close like in browsers; character references are
decoded once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .words import add_columns

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul").split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option title legend".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table td th ul ol dl div section article main aside nav header footer form blockquote".split())
DROPPED = frozenset(("head title script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu audio video "
                     "math map datalist").split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A class or id is boilerplate if all its parts are such words.
BOILERPLATE = re.compile(
    r"ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|"
    r"overlay|newsletters?|subscribe|subscription|comments?|commentlist|replies|respond|disqus|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|masthead|"
    r"social|share|sharing|related|recommend(?:ed|ations?)|widgets?|toolbar|pagination|pager|login|signup|search", re.I)
HEADER = re.compile(r"header|topbar", re.I)
#: Reader comments, with any words before; and notices. Neither is kept for its size.
COMMENTS = re.compile(r"comments?|commentlist|commentary|replies|respond|disqus", re.I)
NOTICES = re.compile(r"cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|banners?|ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?", re.I)
#: Such a word before says something about the page around.
ABOUT = frozenset("no has have with without open closed show hide".split())
WRAPPER, NEVER = 1, 2
PLAIN = frozenset("site page box bar block list area container top bottom".split())
#: Never judged by name.
TEXT = frozenset("p pre blockquote figcaption h1 h2 h3 h4 h5 h6".split())
#: An element of this many unlinked characters and this share of the page's is kept whatever its name, where no article or main is.
LARGE_CHARS, LARGE_SHARE = 250, 0.5
LINK_BOX = frozenset("div section ul ol dl table".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())


class Node:
    __slots__ = ("tag", "up", "parts", "drop", "named", "points", "chars", "linked")

    def __init__(self, tag: str, up: Node | None, drop: bool = False, named: int = 0):
        self.tag, self.up, self.parts, self.drop, self.named = tag, up, [], drop, named
        self.points, self.chars, self.linked = 0.0, 0, 0


def about_comments(names: list[str]) -> bool:
    """Whether a name ends in a word for reader comments (``user-comments``, but not ``has-comments``)."""
    for name in names:
        parts = [x.lower() for x in re.split(r"[-_]+", name) if x and x.lower() not in PLAIN]
        if parts and COMMENTS.fullmatch(parts[-1]) and not ABOUT.intersection(parts):
            return True
    return False


def named(names: list[str], words: re.Pattern) -> bool:
    """Whether a name has such words as parts and no others but plain ones."""
    for name in names:
        parts = [x for x in re.split(r"[-_]+", name) if x and x.lower() not in PLAIN]
        if parts and all(words.fullmatch(x) for x in parts):
            return True
    return False


class Tree(HTMLParser):
    """Builds the elements; text inside dropped elements is not kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.order: list[Node] = [self.root]

    def _inside(self, *tags: str) -> bool:
        node = self.at
        while node is not None:
            if node.tag in tags:
                return True
            node = node.up
        return False

    def _boilerplate(self, tag: str, attrs: list) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header" and not self._inside("article", "main"):
            return True
        return tag not in ("html", "body", "main", "article") and any(
            k == "hidden" or k == "role" and v and v.lower() in ROLES or k == "aria-hidden" and v == "true" for k, v in attrs)

    def _named(self, tag: str, attrs: list) -> int:
        """0, WRAPPER (boilerplate unless it holds the article or most of the text) or NEVER (comments and notices)."""
        names = [x for k, v in attrs if k in ("class", "id") and v for x in v.split()]
        if not names or tag in TEXT or tag in ("html", "body", "main"):
            return 0
        if about_comments(names):
            return NEVER
        if tag == "article":
            return 0
        if named(names, NOTICES):
            return NEVER
        return WRAPPER if named(names, BOILERPLATE) or named(names, HEADER) and not self._inside("article", "main") else 0

    def _close(self, tags: tuple[str, ...], scope: frozenset) -> None:
        node = self.at
        while node is not None and node.tag not in tags:
            if node.tag in scope:
                return
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self._close(("p",), SCOPE)
        if tag in SAME_LEVEL:
            self._close(SAME_LEVEL[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        if tag in VOID:
            self.at.parts.append(Node(tag, self.at))
            return
        node = Node(tag, self.at, self.at.drop or self._boilerplate(tag, attrs), self._named(tag, attrs))
        if not node.drop:
            self.at.parts.append(node)
            self.order.append(node)
        self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.up is not None and tag in ("svg", "path", "g", "use"):
            self.at = self.at.up

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            if node.tag in ("article", "main", "td", "th", "table") and tag not in BLOCK:
                return  # an inline end tag closes nothing beyond its block
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        if not self.at.drop:
            self.at.parts.append(data)


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space folded."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        line = " ".join("".join(run).split())
        run.clear()
        if line:
            out.append(line)

    todo: list = [node]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        elif part.tag in LINK_BOX and part is not node and part.linked > 0.8 * part.chars:
            flush()  # a box of links is a menu
        elif part.tag in BLOCK:
            flush()
            todo.append(None)
            todo.extend(reversed(part.parts))
        else:
            todo.extend(reversed(part.parts))
    flush()
    return out


def score(order: list[Node]) -> None:
    """Text sizes and points of all nodes; children come after their parents in ``order``."""
    for node in order:
        own = " ".join("".join(p for p in node.parts if isinstance(p, str)).split())
        node.chars, node.linked, node.points = len(own), 0, float(own.count(","))
    for node in reversed(order[1:]):
        if node.tag == "a":
            node.linked = node.chars
        node.up.chars += node.chars
        node.up.linked += node.linked
        if node.tag not in BLOCK:
            node.up.points += node.points  # commas of inline text belong to its block
    commas = [node.points for node in order]
    for node in order:
        node.points = 0.0
    for node, n in zip(order, commas, strict=True):
        text_box = node.tag in ("div", "section", "article", "main") and any(isinstance(p, str) and p.strip() for p in node.parts)
        if (node.tag in PARAGRAPH or text_box) and node.chars and node.linked < 0.9 * node.chars:
            earned, up, share = 1 + n + min(3.0, node.chars / 100), (node if text_box else node.up), 1.0
            while up is not None and share > 0.1:
                up.points += earned * share
                up, share = up.up, share / 2 if share == 1.0 else share * 2 / 3
    for node in order:
        node.points *= (1 - node.linked / max(1, node.chars)) * (0.5 if node.named else 1)


def prune(order: list[Node]) -> list[Node]:
    """The nodes without those below boilerplate names.

    What holds an article or main that is no comment stays. Where a page has neither,
    a wrapper with most of the text stays, but never comments and notices.
    """
    if not any(node.named for node in order):
        return order
    score(order)
    comments, holds = set(), set()
    for node in order:  # parents come first
        if node.named == NEVER or node.up in comments:
            comments.add(node)
    for node in order:
        # An article inside comments is one of them; a main is not, whatever stands around it.
        if node.tag == "main" or node.tag == "article" and node not in comments:
            up = node.up
            while up is not None and up not in holds:
                holds.add(up)
                up = up.up
    large = max(LARGE_CHARS, LARGE_SHARE * (order[0].chars - order[0].linked))
    kept = []
    for node in order:
        if node.up is not None and node.up.drop:
            node.drop = True
        elif node.named and node not in holds and (node.named == NEVER or holds or node.chars - node.linked < large):
            node.drop = True
            node.up.parts = [x for x in node.up.parts if x is not node]
        if not node.drop:
            kept.append(node)
    return kept


def main_text(page: str) -> str:
    tree = Tree()
    tree.feed(page)
    tree.close()
    order = prune(tree.order)
    score(order)
    best = max(order, key=lambda n: n.points)
    if best.points <= 0:
        return "\n".join(blocks(tree.root))
    top = best
    while top is not None and top.tag not in ("article", "main"):
        top = top.up
    kept, node, inside = blocks(best), best, top is not None
    while node.up is not None:
        inside = inside and node is not top
        before, after = [], []
        side = before
        for part in node.up.parts:
            if part is node:
                side = after
            elif isinstance(part, str):
                if inside and part.strip():
                    side.append(" ".join(part.split()))
            elif part.chars:
                dense = part.linked / part.chars
                if dense < 0.25 and (inside or part.tag in PARAGRAPH) or part.points >= max(5.0, 0.2 * best.points):
                    side += blocks(part)
        kept = before + kept + after
        if not inside:
            break
        node = node.up
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, ``text`` and ``n_chars`` (its code points)."""

    def make():
        def fn(rows, data, offsets):
            raw = data.tobytes()
            texts = [main_text(raw[a:b].decode("utf-8", "replace")) if b > a else "" for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return fn

    return add_columns(pages, make, "text string, n_chars long", html, keep)
