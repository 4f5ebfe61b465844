"""A small forgiving HTML tree over the standard library's tokenizer; Spark has no HTML functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset(("script", "style", "noscript"))
_BLOCKS = "address blockquote caption center col colgroup dd dir div dl dt fieldset form frameset h1 h2 h3 h4 h5 h6 hr li listing menu ol p pre table tbody td tfoot th title tr ul xmp"
_HEADING = "fieldset form li p table"
#: Start tags that end an open element of the key, where it is the innermost one, as lenient parsers of HTML 4 do.
ENDED_BY = {
    "a": "a fieldset table td th",
    "address": "dd dl dt form li ul",
    "b": "center p td th",
    "big": "p",
    "caption": "col colgroup tbody tfoot thead tr",
    "col": "col colgroup tbody tfoot thead tr",
    "colgroup": "colgroup tbody tfoot thead tr",
    "dd": "dt",
    "dir": "dd dl dt form ul",
    "dl": "form li",
    "dt": "dd dl",
    "font": "center td th",
    "form": "form",
    "h1": _HEADING,
    "h2": _HEADING,
    "h3": _HEADING,
    "h4": _HEADING,
    "h5": _HEADING,
    "h6": _HEADING,
    "i": "center",
    "legend": "fieldset",
    "li": "li",
    "menu": "dd dl dt form ul",
    "ol": "form ul",
    "option": "optgroup option",
    "p": _BLOCKS,
    "pre": "dd dl dt fieldset form li table ul",
    "s": "p",
    "small": "p",
    "span": "td th",
    "strike": "p",
    "tbody": "tbody tfoot",
    "td": "tbody td tfoot th tr",
    "tfoot": "tbody",
    "th": "tbody td tfoot th tr",
    "thead": "tbody tfoot",
    "tr": "tbody tfoot tr",
    "tt": "p",
    "u": "p td th",
    "ul": "address form menu ol pre",
}
ENDED_BY = {k: frozenset(v.split()) for k, v in ENDED_BY.items()}
#: An end tag does not reach beyond an open element of a higher rank; others have 100.
RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "tbody": 180, "tfoot": 180, "thead": 180, "table": 190, "body": 200, "head": 200, "html": 220}
#: What may stand in a head; anything else begins the body.
IN_HEAD = frozenset("base link meta noscript script style title".split())
FRAME = frozenset(("html", "head", "body"))
ROOT = "[document]"


def clean(text: str) -> str:
    """X-8."""
    return " ".join(text.split())


class Node:
    __slots__ = ("tag", "attrs", "inner", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.inner = tag, attrs, parent, []

    @property
    def level(self) -> int:
        """1 to 6 for headings, else 0."""
        return int(self.tag[1]) if len(self.tag) == 2 and self.tag[0] == "h" and self.tag[1] in "123456" else 0

    def walk(self) -> Iterator[Node | str]:
        """Elements and texts below this one in document order, without recursion: pages may nest deeply."""
        todo = self.inner[::-1]
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo.extend(reversed(x.inner))

    def elements(self, *tags: str) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node) and (not tags or x.tag in tags))

    def text(self, between: str = "") -> str:
        return between.join(x for x in self.walk() if isinstance(x, str))

    def after(self) -> list[Node]:
        """Following sibling elements."""
        around = self.parent.inner
        return [x for x in around[next(i for i, x in enumerate(around) if x is self) + 1 :] if isinstance(x, Node)]

    def section(self) -> list[Node]:
        """What follows a heading up to the next one of its rank or above."""
        out = []
        for x in self.after():
            if 0 < x.level <= self.level:
                break
            out.append(x)
        return out

    def remove(self) -> None:
        self.parent.inner = [x for x in self.parent.inner if x is not self]


class _Builder(HTMLParser):
    """Repairs as it builds: start tags end what they cannot stand in, end tags end what is open within, paragraphs arise from text beside the body.

    Elements are closed in the order in which they were opened, so what overlaps is cut where the outer one ends.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node(ROOT, {}, None)
        self.quiet: list[str] = []
        self.framed: set[str] = set()

    def _opened(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.at)
        self.at.inner.append(node)
        if tag not in VOID:
            self.at = node

    def _leave_head(self) -> None:
        x = self.at
        while x.parent is not None and x.tag != "head":
            x = x.parent
        if x.tag == "head":
            self.at = x.parent

    def handle_starttag(self, tag, attrs):
        if tag in NOISE:
            self._parted()
            self.quiet.append(tag)
        if self.quiet:
            return
        if tag in FRAME:
            if tag in self.framed or tag == "html" and self.root.inner or tag == "head" and "body" in self.framed:
                return  # there is one of each
            self.framed.add(tag)
        if tag not in IN_HEAD and tag not in ("html", "head"):
            self._leave_head()
        while self.at.parent is not None and tag in ENDED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        self._opened(tag, {k: v or "" for k, v in reversed(attrs)})

    def handle_endtag(self, tag):
        if self.quiet:
            if tag in self.quiet:
                del self.quiet[self.quiet.index(tag) :]
            return
        if tag in NOISE or tag in ("html", "body"):
            return  # what follows the end of the body still belongs to it
        x = self.at
        while x.parent is not None:
            if x.tag == tag:
                self.at = x.parent
                return
            if RANK.get(x.tag, 100) > RANK.get(tag, 100):
                break
            x = x.parent
        if tag == "p":  # the end of a paragraph that never began is an empty one
            self.handle_starttag("p", [])
            self.at = self.at.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.quiet or not data:
            return
        if self.at.tag in (ROOT, "html", "head"):
            if not data.strip():
                return
            self._leave_head()
            self._opened("p", {})
        own = self.at.inner
        if own and isinstance(own[-1], str) and own[-1]:
            own[-1] += data  # the tokenizer cuts texts at odd signs
        else:
            own.append(data)

    def _parted(self) -> None:
        """Texts on both sides of what is left out are two."""
        if not self.quiet and self.at.tag not in (ROOT, "html", "head"):
            self.at.inner.append("")

    def handle_comment(self, data):
        self._parted()


_CUT_TAG = re.compile(r"<[A-Za-z/][^<>]*\Z")


def tree(html: str) -> Node:
    """E-1: the document without comments, scripts, styles and noscript parts, repaired; a tag that the end of the page cuts is no text."""
    b = _Builder()
    b.feed(_CUT_TAG.sub("", html))
    b.close()
    return b.root


def headings(root: Node, texts: set[str]) -> list[Node]:
    return [x for x in root.elements() if x.level and clean(x.text(" ")) in texts]


LINE_ENDS = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85  ]")


def lines(root: Node) -> list[str]:
    """X-9 over the texts of all elements but embedded frames."""
    hidden = {id(y) for f in root.elements("iframe") for y in f.inner}
    text = "\n".join(x for x in root.walk() if isinstance(x, str) and id(x) not in hidden)
    return [c for x in LINE_ENDS.split(text) if (c := clean(x))]
