"""Main-text extraction by tree scoring (operator 8).

A page is read once into a tree of elements whose text is cut into blocks (runs
of inline text between block-level tags). Elements that are never article text
(menus, page headers and footers, sidebars, notices, adverts, forms, scripts,
comments; by tag, role, hidden state or words of class and id) are left out with
all they hold. Every remaining block passes points to its ancestors: one, plus
one per comma, plus up to three for length; the parent gets them in full, the
grandparent half, further ancestors a third, a quarter, ... A container's points
are discounted by its link density. The best container (widened to the article
or main element it lies in) is kept, with those siblings that score a fifth of
it or that read like text (headings, low link density). Where the text lies in
several containers of one depth, each wrapped on its own, the best one is first
widened to its branch below their common ancestor. Kept blocks, white space
collapsed, are joined in page order by one newline; nothing is cut or capped.

Edge cases: null or empty html, or a page without any article block, gives the
empty text. Unclosed and stray tags are tolerated (a block-level start closes an
open paragraph; end tags without a start are ignored). Hidden inline elements and inline
adverts are left out, to the end of the element around them if they are not closed. Repeated rows and extra
columns are kept; empty table: empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import prepare

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main
menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead
title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start of one of the first closes an open one of the second (up to a container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}}
LISTS = frozenset("ul ol dl table select menu body html div article section main".split())
DROP = frozenset("""script style noscript template textarea title head iframe object embed svg canvas nav
aside footer form button select option input label fieldset menu dialog audio video map""".split())
ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert menu menubar
form toolbar tablist status""".split())
BAD = frozenset("""ad ads adv advert adverts advertisement advertising adbox adslot adsense banner sponsor
sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars rail footer
header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login
share sharing social related recommended recommendations widget toolbar pagination pager skip hidden
disclaimer alert toast topbar""".split())
ALWAYS_BAD = frozenset("comment comments disqus respond replies reply discussion reactions".split())
INLINE_BAD = frozenset("ad ads adv advert advertisement adsense sponsor sponsored".split())
FOREIGN = frozenset("svg math".split())
GOOD = frozenset("article content body main post entry story text page".split())


class Node:
    __slots__ = ("tag", "parent", "dropped", "chars", "link_chars", "points", "children", "wide")

    def __init__(self, tag, parent, dropped):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.chars = self.link_chars = 0
        self.points = 0.0
        self.children: list = []       # nodes and block numbers, in page order
        self.wide = tag in ("article", "main")
        if parent is not None:
            parent.children.append(self)


def _attributes(attrs: str) -> dict[str, str]:
    a = {}
    for m in _ATTR.finditer(attrs):
        a.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return a


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(
        re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")))


def _dropped_inline(attrs: str) -> bool:
    """Whether an inline element is hidden or an advert."""
    if not attrs or attrs.isspace():
        return False
    a = _attributes(attrs)
    return _hidden(a) or bool(INLINE_BAD & set(_WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")))


def _dropped(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in DROP or (tag == "header" and not inside_article):
        return True
    if not attrs or attrs.isspace():
        return False
    a = _attributes(attrs)
    if _hidden(a) or a.get("role") in ROLES:
        return True
    if tag in ("html", "body"):
        return False
    words = set(_WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}"))
    if words & ALWAYS_BAD:
        return True
    if tag in ("article", "main") or words & GOOD:
        return bool(words & {"sidebar", "footer", "nav", "menu", "related", "ad", "ads"}) and tag not in ("article", "main")
    return bool(words & BAD)


class Page:
    """The tree of a page with its kept blocks."""

    def __init__(self, source: str):
        self.root = Node("#root", None, False)
        self.blocks: list[tuple[str, Node]] = []
        self.node, self.links, self.articles = self.root, 0, 0
        self.open: list[str] = []      # text pieces of the current block
        self.linked = 0                # their characters inside links
        # inside a dropped inline element: its tag, how many of them are open, the element around
        self.skip_tag, self.skip, self.skip_in = "", 0, None
        self._read(source)

    def _flush(self):
        if not self.open:
            return
        text = " ".join("".join(self.open).split())
        if text and not self.node.dropped:
            n, link = len(text), min(self.linked, len(text))
            at = self.node
            at.children.append(len(self.blocks))
            self.blocks.append((text, at))
            points = 1.0 + text.count(",") + min(n / 100.0, 3.0)
            points *= 1.0 - link / n
            # a block element's own text counts for its parent; bare text in a container for the container
            box = at.parent if at.tag in ("p", "pre", "blockquote", "td", "li", "dd", "dt") or at.tag in HEADINGS else at
            depth, up = 0, box
            while up is not None:
                up.points += points / (1, 2, 3)[depth] if depth < 3 else points / (depth + 1)
                depth, up = depth + 1, up.parent
            while at is not None:
                at.chars += n
                at.link_chars += link
                at = at.parent
        self.open, self.linked = [], 0

    def _text(self, s: str):
        if s and not self.skip and not self.node.dropped:
            if "&" in s:
                s = html_lib.unescape(s)
            self.open.append(s)
            if self.links:
                self.linked += len(" ".join(s.split()))

    def _close_to(self, node: Node):
        """End every element inside and including ``node``."""
        while self.node is not node:
            self._leave()
        self._leave()

    def _leave(self):
        if self.node.wide:
            self.articles -= 1
        if self.node is self.skip_in:      # an inline element ends with the one around it
            self.skip, self.skip_in = 0, None
        self.node = self.node.parent

    def _start(self, tag: str, attrs: str):
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag not in BLOCK and tag not in DROP:    # inline markup changes no block
            if tag == "a":
                self.links = 1
            if self.skip:
                self.skip += tag == self.skip_tag
            elif _dropped_inline(attrs):
                self.skip_tag, self.skip, self.skip_in = tag, 1, self.node
            return
        self._flush()
        if tag in BLOCK and self.node.tag == "p":
            self._leave()
        stops = CLOSES.get(tag)
        if stops:
            at = self.node
            while at.parent is not None and at.tag not in LISTS:
                if at.tag in stops:
                    self._close_to(at)
                    at = self.node
                    continue
                at = at.parent
        node = Node(tag, self.node, self.node.dropped or _dropped(tag, attrs, self.articles > 0))
        self.node = node
        self.links = 0
        if node.wide:
            self.articles += 1

    def _end(self, tag: str):
        if tag not in BLOCK and tag not in DROP:
            if tag == "a":
                self.links = 0
            if self.skip and tag == self.skip_tag:
                self.skip -= 1
            return
        at = self.node
        while at.parent is not None and at.tag != tag:
            if tag == "p" and at.tag in LISTS:
                return
            at = at.parent
        if at.parent is None:
            return
        self._flush()
        self.links = 0
        self._close_to(at)

    def _read(self, s: str):
        at, n = 0, len(s)
        while at < n:
            m = _TOKEN.search(s, at)
            if m is None:
                break
            self._text(s[at:m.start()])
            at = m.end()
            close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                if m[0].startswith("<![CDATA["):
                    self._text(html_lib.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = name.lower()
            if close:
                self._end(tag)
                continue
            if tag in FOREIGN and attrs.endswith("/"):      # closed at once
                continue
            self._start(tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(s, at)
                at = end.end() if end else n
                if self.node.tag == tag:
                    self._leave()
        self._text(s[at:])
        self._flush()

    def score(self, node: Node) -> float:
        return node.points * (1.0 - node.link_chars / node.chars) if node.chars else 0.0

    def _nodes(self, node: Node) -> Iterator[Node]:
        todo = [node]
        while todo:
            at = todo.pop()
            yield at
            todo += [c for c in reversed(at.children) if isinstance(c, Node)]

    def _blocks(self, node: Node) -> Iterator[int]:
        todo: list = [node]
        while todo:
            at = todo.pop()
            if isinstance(at, int):
                yield at
            else:
                todo += reversed(at.children)

    def _peers(self, best: Node, top: float) -> set[Node]:
        """``best`` and the containers of its depth that score a fifth of it."""
        depth, peers = {self.root: 0}, {best}
        for node in self._nodes(self.root):
            if node.parent is not None:
                depth[node] = depth[node.parent] + 1
        for node, d in depth.items():
            if d == depth[best] and node.chars and not node.dropped and node.link_chars / node.chars < 0.25 \
                    and self.score(node) >= 0.2 * top:
                peers.add(node)
        return peers

    def _text_of(self, node: Node, peers: set[Node], above: set[Node]) -> Iterator[int]:
        """The blocks of a branch; of one full of links only those of the peers in it."""
        todo = [node]
        while todo:
            at = todo.pop()
            if at in peers or at.link_chars / at.chars < 0.25:
                yield from self._blocks(at)
            else:
                todo += [c for c in at.children if c in above]

    def text(self) -> str:
        best, top = None, 0.0
        for node in self._nodes(self.root):
            if node.chars and not node.dropped:
                s = self.score(node)
                if s > top or (s == top and best is None):
                    best, top = node, s
        if best is None or top <= 0:
            return ""
        at, wide = best, None
        while at is not None:
            if at.wide:
                wide = at
            at = at.parent
        best = wide or best
        # a plain container may be one of several sections, each wrapped on its own
        peers, above = ({best}, set()) if wide else (self._peers(best, top), set())
        for at in peers:
            while at is not None and at not in above:
                above.add(at)
                at = at.parent
        at = best
        while at.parent is not None and wide is None:
            if any(c is not at and c in above for c in at.parent.children):
                best = at
            at = at.parent
        kept = set(self._text_of(best, peers, above))
        box = best.parent
        # an article element is complete; a plain container may have spilled into siblings
        if box is not None and wide is None:
            for sib in box.children:
                if isinstance(sib, int):
                    kept.add(sib)
                elif sib is not best and sib.chars and not sib.dropped:
                    density = sib.link_chars / sib.chars
                    if sib in above:
                        kept.update(self._text_of(sib, peers, above))
                    elif density < 0.25 and (self.score(sib) >= 0.2 * top or sib.tag in HEADINGS
                                             or sib.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "figure", "section")):
                        kept.update(self._blocks(sib))
        elif box is not None:
            for sib in box.children:   # a page may hold its text in several article elements
                if isinstance(sib, Node) and sib is not best and sib.wide and sib.tag == best.tag and sib.chars \
                        and self.score(sib) >= 0.2 * self.score(best):
                    kept.update(self._blocks(sib))
        return "\n".join(self.blocks[i][0] for i in sorted(kept))


def extract(source: str | None) -> str:
    return Page(source).text() if source else ""


def with_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` plus text and n_chars (code points of text); input columns of
    these names are replaced."""
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(extract, na_action=None)

    out = pages.withColumn("text", main_text(F.coalesce(F.col(html), F.lit(""))))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
