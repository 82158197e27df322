"""The main text of a page that no rule knows: blocks scored by length and punctuation, holders by their blocks.

A block of running text adds to its holder and half as much to what holds that; links take away their share. The best holder is
taken with those of its neighbours that score well or read like text.
"""

from __future__ import annotations

import re

from leafwright.pages.dom import BLOCKS, HIDDEN, Node

LEAST_BLOCK, LEAST_TEXT = 25, 140
HELPFUL = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)
HARMFUL = re.compile(r"(?:^|[\s_-])(?:comment|combx|footer|footnote|nav|menu|sidebar|aside|sponsor|advert|ads?|promo|related|recommend|share|social|breadcrumb|cookie|subscribe|newsletter|pager?|popup|widget|tags?)(?:$|[\s_-])", re.I)
WEIGHTS = {"article": 10.0, "main": 8.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "form": -8.0, "ul": -3.0, "ol": -3.0, "nav": -25.0, "aside": -15.0, "header": -5.0, "footer": -15.0}
NEIGHBOUR, NEIGHBOUR_LEAST = 0.2, 10.0
MARKS = re.compile("[,;:，、；：。.!?！？]")


def _weight(n: Node) -> float:
    w = WEIGHTS.get(n.tag, 0.0)
    if n.attrs:
        if HARMFUL.search(n.marks):
            w -= 25.0
        if HELPFUL.search(n.marks):
            w += 15.0
    return w


def _is_text(n: Node) -> bool:
    return n.tag in ("p", "pre", "td", "blockquote") or n.tag in ("div", "section", "article") and not any(isinstance(c, Node) and (c.tag in BLOCKS or c.first(*BLOCKS) is not None) for c in n.children)


def link_share(n: Node) -> float:
    whole = len(n.text())
    return sum(len(a.text()) for a in n.all("a")) / whole if whole else 0.0


def readable(root: Node) -> Node | None:
    """An element that holds the main text, or null if the page has none."""
    scores: dict[int, float] = {}
    holders: dict[int, Node] = {}

    def add(n: Node | None, value: float) -> None:
        if n is None or n.tag == "#root":
            return
        if id(n) not in scores:
            scores[id(n)], holders[id(n)] = _weight(n), n
        scores[id(n)] += value

    for n in root.walk():
        if n.tag in HIDDEN or not _is_text(n):
            continue
        text = n.text()
        if len(text) < LEAST_BLOCK or any(a.tag in HIDDEN or a.tag in ("nav", "footer", "aside") for a in n.above()):
            continue
        value = 1.0 + len(MARKS.findall(text)) + min(len(text) / 100, 3.0)
        add(n.parent, value)
        add(n.parent.parent if n.parent else None, value / 2)
    if not scores:
        return None
    final = {k: s * (1 - link_share(holders[k])) if s > 0 else s for k, s in scores.items()}
    best = max(final, key=lambda k: final[k])
    node = holders[best]
    if final[best] <= 0:
        return None
    kept = [node]
    if node.parent is not None:
        least = max(NEIGHBOUR_LEAST, NEIGHBOUR * final[best])
        kept = []
        for c in node.parent.children:
            if not isinstance(c, Node):
                continue
            plain = c.tag == "p" and len(c.text()) >= 80 and link_share(c) < 0.25
            same = 0.2 * final[best] if c.attrs.get("class") and c.attrs.get("class") == node.attrs.get("class") else 0.0
            if c is node or final.get(id(c), 0.0) + same >= least or plain:
                kept.append(c)
    whole = kept[0] if len(kept) == 1 else Node("#root", {}, None)
    if len(kept) > 1:
        whole.children.extend(kept)
    return whole if len(whole.text()) >= LEAST_TEXT else None


# Elements that may hold a page's text, how long it must be, how many are kept, and the share of an outer one's text from which an inner one says the same.
CANDIDATE_TAGS, CANDIDATE_TEXT, CANDIDATES, SAME = ("article", "div", "section", "main", "p"), 300, 8, 0.85


def candidates(root: Node, most: int = CANDIDATES, least: int = CANDIDATE_TEXT, same: float = SAME) -> list[tuple[Node, int]]:
    """The elements of most text with its length, the longest first, of equals the first; one that holds nearly all of a kept element around it is passed over."""
    lengths = [(n, len(n.text(""))) for n in root.all(*CANDIDATE_TAGS)]
    kept: list[tuple[Node, int]] = []
    sizes: dict[int, int] = {}
    for node, length in sorted((x for x in lengths if x[1] >= least), key=lambda x: -x[1]):
        if any(id(a) in sizes and length > same * sizes[id(a)] for a in node.above()):
            continue
        kept.append((node, length))
        sizes[id(node)] = length
        if len(kept) == most:
            break
    return kept
