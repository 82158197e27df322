"""A tolerant tree of an HTML page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))
BLOCKS = frozenset("p div section article main header footer aside nav li ul ol dl dt dd blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption table tr td th thead tbody tfoot form".split())
# what an opening tag closes, if it is open below the nearest of the tags after the bar
IMPLIED = {
    "p": ({"p"}, {"div", "section", "article", "li", "td", "th", "blockquote", "body", "main", "figure"}),
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCKS - {"p", "tr", "td", "th", "thead", "tbody", "tfoot", "li", "dt", "dd"}
BLANKS = re.compile(r"\s+")


class Node:
    """An element, with its children; texts are children of type str."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def first(self, *tags: str) -> Node | None:
        return next(self.all(*tags), None)

    def raw(self) -> str:
        """All text, as it stands."""
        return "".join(self._texts(frozenset()))

    def text(self, joint: str = " ") -> str:
        """Visible text, pieces stripped and joined."""
        return joint.join(t for t in (BLANKS.sub(" ", x).strip() for x in self._texts(HIDDEN)) if t)

    def _texts(self, skipped: frozenset[str]) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in skipped:
                stack.extend(reversed(x.children))

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    @property
    def marks(self) -> str:
        """Class and id."""
        return f"{self.attrs.get('id', '')} {self.attrs.get('class', '')}".strip()

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closed, fence = IMPLIED.get(tag, (frozenset(), frozenset()))
        if tag in CLOSES_P:
            closed, fence = {"p"}, IMPLIED["p"][1]
        if closed:
            node = self.at
            while node.parent is not None and node.tag not in fence:
                if node.tag in closed:
                    self.at = node.parent
                    if tag not in ("tr",):
                        break
                node = node.parent
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        node = Node(tag, values, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.parent is not None and tag in ("svg", "path", "circle", "rect", "use"):
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent  # an end tag without its start is ignored

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SELECTOR = re.compile(r"^(\w+)?(?:([#.])([\w-]+))?(?:\[(\w+)\^=\"([^\"]*)\"\])?$")


def select_all(root: Node, selector: str) -> Iterator[Node]:
    """Elements of a simple selector, in order: tag, tag.class, tag#id, #id or tag[attribute^="start"]."""
    m = _SELECTOR.match(selector)
    if not m:
        raise ValueError(selector)
    tag, kind, name, attribute, start = m.groups()
    for n in root.walk():
        if tag and n.tag != tag:
            continue
        if kind == "#" and n.attrs.get("id") != name or kind == "." and name not in n.classes():
            continue
        if attribute and not n.attrs.get(attribute, "").startswith(start):
            continue
        yield n


def select(root: Node, selector: str) -> Node | None:
    """The first of :func:`select_all`."""
    return next(select_all(root, selector), None)


def absolute_links(root: Node, base: str, pattern: str | None = None) -> list[str]:
    """Distinct http(s) links without fragment, in order, optionally only those that match ``pattern``."""
    from urllib.parse import urldefrag, urljoin

    found = dict.fromkeys(urldefrag(urljoin(base, a.attrs["href"].strip()))[0] for a in root.all("a") if a.attrs.get("href", "").strip())
    return [u for u in found if u.startswith(("http://", "https://")) and (pattern is None or re.search(pattern, u))]
