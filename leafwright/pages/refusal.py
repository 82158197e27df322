"""Pages to refuse: paywalls, lists, empty shells and photo sets.

Python measures a page once; the verdict is a CASE over the measures, so that thresholds can be swept as columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwright.pages.body import CONTAINERS
from leafwright.pages.dom import HIDDEN, Node, select

# Thresholds of the rules, names of images that decorate, marks of captions, and elements that may hold a set.
THRESHOLDS = {
    "list_links": 30, "list_share": 0.55, "shell_text": 200, "thin_text": 400, "thin_share": 0.4, "thin_paragraphs": 150, "thin_links": 20,
    "set_least": 6, "set_paragraph": 200, "set_outside": 400, "set_images": 8, "set_share": 0.5, "set_bare": 15, "set_text": 120, "set_captions": 6, "captioned_share": 0.4, "captioned_text": 150,
}
DECORATION = re.compile("icon|logo|qrcode|avatar|blank|pixel|loading|arrow|sound|counter|sprite|btn", re.I)
CAPTION = re.compile("caption|pictext|desc", re.I)
HOLDERS = ("article", "div", "section", "ul")
LONG_LINK, LONG_PARAGRAPH = 12, 100

SET = "images int, text int, longest_paragraph int, outside int, nested int, captions int, caption_text int"
MEASURES = f"paywall boolean, page_text int, long_links int, long_link_text int, links int, link_text int, paragraph_text int, images int, sets array<struct<{', '.join(x.replace(' ', ': ', 1) for x in SET.split(', '))}>>"


def _visible(node: Node) -> int:
    return len(node.text(""))


def content_images(node: Node) -> list[Node]:
    """Images that aren't in links and don't decorate."""
    return [i for i in node.all("img") if not DECORATION.search(f"{i.attrs.get('class', '')} {i.attrs.get('id', '')}{i.attrs.get('src', '')}") and not any(a.tag == "a" for a in i.above())]


def _caption(img: Node) -> str:
    figure = next((a for a in img.above() if a.tag == "figure"), None)
    if figure is not None and (own := figure.first("figcaption")) is not None:
        return own.text("")
    parent = img.parent
    if parent is None:
        return ""
    if CAPTION.search(parent.marks):
        return parent.text("")
    if parent.parent is not None:
        around = [c for c in parent.parent.children if isinstance(c, Node)]
        after = around[around.index(parent) + 1 :][:1]
        if after and CAPTION.search(after[0].marks):
            return after[0].text("")
    return ""


def measure(root: Node) -> dict:
    """The measures of one page, for :func:`verdict`; ``sets`` has an entry for each element that holds several images."""
    links = [a.text("") for a in root.all("a")]
    long_links = [t for t in links if len(t) >= LONG_LINK]
    images = content_images(root)
    sets = []
    if len(images) >= 2:
        held: dict[int, list[Node]] = {}
        holders: dict[int, Node] = {}
        for i in images:
            for a in i.above():
                if a.tag in HOLDERS:
                    held.setdefault(id(a), []).append(i)
                    holders[id(a)] = a
        paragraphs = [(p, len(p.text(""))) for p in root.all("p")]
        for key, own in held.items():
            node = holders[key]
            if len(own) < 2:
                continue
            below = [len(held[id(d)]) for d in node.walk() if d is not node and id(d) in held]
            inside = {id(p) for p in node.all("p")}
            captions = [c for c in map(_caption, own) if c]
            sets.append({
                "images": len(own), "text": _visible(node), "longest_paragraph": max((n for p, n in paragraphs if id(p) in inside), default=0),
                "outside": sum(n for p, n in paragraphs if id(p) not in inside and n > LONG_PARAGRAPH), "nested": max(below, default=0), "captions": len(captions), "caption_text": sum(map(len, captions)),
            })
    return {
        "paywall": any(n.attrs.get("id") == "chargeWall" for n in root.walk()),
        "page_text": _visible(root), "long_links": len(long_links), "long_link_text": sum(map(len, long_links)), "links": len(links), "link_text": sum(map(len, links)),
        "paragraph_text": sum(len(p.text("")) for p in root.all("p")), "images": len(images), "sets": sets,
    }


def verdict(m: Column, limits: dict[str, float | Column] | None = None) -> Column:
    """Reason for refusal, or null: the first rule that a page's measures meet. Any threshold may be a column."""
    t = {**THRESHOLDS, **(limits or {})}
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def is_set(s: Column) -> Column:
        each, told = share(s["text"], s["images"]), share(s["caption_text"], s["text"])
        article = (s["longest_paragraph"] > t["set_paragraph"]) | (s["outside"] >= t["set_outside"])  # running text inside, or an article beside the pictures
        captioned = (s["captions"] >= t["set_captions"]) & (told >= t["captioned_share"])
        innermost = (s["images"] >= t["set_images"]) & (s["images"] >= m["images"] * t["set_share"]) & (s["nested"] < t["set_images"])
        return (s["images"] >= t["set_least"]) & ~article & (innermost & ((each < t["set_bare"]) | captioned) & (each < t["set_text"]) | captioned & (each < t["captioned_text"]))

    return (
        F.when(m["paywall"], "paywall")
        .when((m["long_links"] >= t["list_links"]) & (share(m["long_link_text"], m["page_text"]) >= t["list_share"]), "list_page")
        .when(m["page_text"] < t["shell_text"], "empty_shell")
        .when((m["page_text"] < t["thin_text"]) & (share(m["link_text"], m["page_text"]) >= t["thin_share"]) & (m["paragraph_text"] < t["thin_paragraphs"]) & (m["links"] >= t["thin_links"]), "list_page")
        .when(F.exists(m["sets"], is_set), "photo_set")
    )


def as_photo_set(root: Node, images: int, caption: str, intro: str = "") -> None:
    """Replaces the main container of a page, a known system's or the ``div`` of most text, by a gallery; for calibration."""
    target = next((n for n in (select(root, s) for s, _ in CONTAINERS) if n is not None), None)
    if target is None:
        target = max((n for n in root.all("div") if n.tag not in HIDDEN), key=lambda n: len(n.text("")), default=None)
    if target is None or target.parent is None:
        target = root.first("body") or root

    def element(tag: str, parent: Node, text: str | None = None, **attrs: str) -> Node:
        node = Node(tag, attrs, parent)
        if text is not None:
            node.children.append(text)
        parent.children.append(node)
        return node

    gallery = Node("div", {"class": "photo-gallery"}, target.parent or target)
    if intro:
        element("p", gallery, intro)
    for i in range(images):
        figure = element("figure", gallery)
        element("img", figure, src=f"https://pictures.example/p{i}.jpg")
        element("figcaption", figure, caption)
    if target.parent is None:
        target.children = [gallery]
    else:
        at = next(k for k, c in enumerate(target.parent.children) if c is target)
        target.parent.children[at] = gallery
