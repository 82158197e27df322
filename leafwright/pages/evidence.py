"""What a page says about itself, as it stands: meta tags, JSON-LD, headings, bylines. Nothing is judged here."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

from leafwright.pages.dom import BLANKS, HIDDEN, Node

# Article types, and the meta tags of each field in order.
ARTICLE_TYPES = {"newsarticle", "article", "blogposting", "techarticle", "reportagenewsarticle", "scholarlyarticle", "socialmediaposting"}
META = {
    "title": ("og:title", "twitter:title"),
    "publish_time": ("article:published_time", "og:release_date", "publishdate", "pubdate", "date", "firstpublishedtime"),
    "update_time": ("article:modified_time", "lastmodifiedtime"),
    "authors": ("article:author", "author"),
}
# Marks of elements that hold times, and how long such a text may be.
TIME_PLACE, TIME_LENGTH = re.compile("time|date|info|source|byline", re.I), (4, 120)
BYLINE_PLACE, BYLINE_LENGTH = re.compile("byline|author|editor|info|source|time|meta|edit", re.I), 150
CAPTION_PLACE = re.compile("pictext|caption|photo", re.I)
HEADING_DEPTH = 6

_WANTED = {k for keys in META.values() for k in keys}


def plain(text: str) -> str:
    """Entities resolved until nothing changes, three times at most."""
    for _ in range(3):
        after = unescape(text)
        if after == text:
            break
        text = after
    return text.strip()


def nodes(data: object) -> Iterator[dict]:
    """The objects of JSON-LD, those of lists and graphs included."""
    if isinstance(data, list):
        for x in data:
            yield from nodes(x)
    elif isinstance(data, dict):
        yield data
        yield from nodes(data.get("@graph") or [])


def _people(value: object) -> list[str]:
    each = value if isinstance(value, list) else [value]
    return [n for n in (plain(str(x.get("name") or "")) if isinstance(x, dict) else plain(x) if isinstance(x, str) else "" for x in each) if n]


def json_ld(root: Node) -> list[dict]:
    """Headline, authors and times of each article object, in order; scripts that are no JSON are passed over."""
    found = []
    for script in root.all("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads(script.raw())
        except ValueError:
            continue
        for node in nodes(data):
            kinds = node.get("@type")
            if {str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])} & ARTICLE_TYPES:
                text = lambda key: plain(str(node[key])) if node.get(key) else None  # noqa: B023, E731
                found.append({"headline": text("headline"), "authors": _people(node.get("author")), "published": text("datePublished"), "modified": text("dateModified")})
    return found


def meta_tags(root: Node, wanted: set[str] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """Contents of meta tags by property and by name; of equal tags the first counts."""
    wanted = _WANTED if wanted is None else wanted
    properties: dict[str, str] = {}
    names: dict[str, str] = {}
    for tag in root.all("meta"):
        for own, attribute in ((properties, "property"), (names, "name")):
            if tag.attrs.get(attribute) in wanted:
                own.setdefault(tag.attrs[attribute], tag.attrs.get("content", "").strip())
    return properties, names


def heading(root: Node) -> tuple[str | None, list[str]]:
    """Text of the first main heading, and the marks of up to six elements above it, the nearest first."""
    h1 = root.first("h1")
    if h1 is None or not h1.text():
        return None, []
    marks: list[str] = []
    for node in h1.above():
        if len(marks) == HEADING_DEPTH or node.tag in ("body", "#root"):
            break
        marks.append(node.marks)
    return BLANKS.sub(" ", h1.text()), marks


def places(root: Node) -> tuple[list[str], list[str], list[str]]:
    """Distinct texts of elements that may hold a time, of those that may hold a byline, and of captions, in order."""
    times: dict[str, None] = {}
    bylines: dict[str, None] = {}
    captions: dict[str, None] = {}
    for n in root.walk():
        if n.tag in HIDDEN:
            continue
        timed, caption = bool(n.attrs) and bool(TIME_PLACE.search(n.marks)), n.tag == "figcaption" or bool(n.attrs) and bool(CAPTION_PLACE.search(n.marks))
        signed = bool(n.attrs) and bool(BYLINE_PLACE.search(f"{n.marks} {n.attrs.get('data-role', '')} {n.attrs.get('rel', '')}"))
        if timed or signed:
            text = BLANKS.sub(" ", n.text())
            if timed and TIME_LENGTH[0] <= len(text) <= TIME_LENGTH[1]:
                times.setdefault(text)
            if signed and 0 < len(text) <= BYLINE_LENGTH:
                bylines.setdefault(text)
        if caption and (text := n.text("\n")):
            captions.setdefault(text)
    return list(times), list(bylines), list(captions)


# What a line must hold to be shown to an annotator as a byline, and how much of it.
SHOWN_BYLINE = re.compile(r"(?:记者|作者|文/|摄|摄影|责任编辑|编辑|来源|By\s+[A-Z]|Byline|Reporter|Editor|Source)[：: ]{0,3}[^\n<>]{0,60}")
SHOWN_PLACE = re.compile("[iI]nfo|[sS]ource|author|time|editor|byline")
SHOWN = 12
SHOWN_META = {"title", "author", "publishdate", "publishdate2", "firstpublishedtime", "lastmodifiedtime", "pubdate", "source", "date", "article:published_time", "article:modified_time", "og:title", "twitter:title"}


def dump(root: Node) -> dict:
    """All evidence of a page for an annotator: titles, meta tags, JSON-LD, time elements, the first twelve byline candidates, and counts."""
    properties, names = meta_tags(root, SHOWN_META)
    title = root.first("title")
    scripts = [s.raw().strip() for s in root.all("script") if s.attrs.get("type") == "application/ld+json"]
    bylines: dict[str, None] = {}
    for n in root.walk():
        if n.attrs.get("class") and SHOWN_PLACE.search(n.attrs["class"]):
            text = BLANKS.sub(" ", n.text())
            if text and len(text) < 200 and SHOWN_BYLINE.search(text):
                bylines.setdefault(text[:160])
    whole = len(root.text())
    return {
        "title_tag": (title.text() or None) if title is not None else None,
        "headings": [t for t in (h.text() for h in root.all("h1")) if t][:3],
        "meta": properties | {k: v for k, v in names.items() if v},
        "json_ld": [s for s in scripts if s],
        "times": [{"datetime": t.attrs.get("datetime"), "text": t.text()[:80]} for t in root.all("time")],
        "bylines": list(bylines)[:SHOWN],
        "text_length": whole,
        "links": sum(1 for _ in root.all("a")),
        "link_share": sum(len(a.text()) for a in root.all("a")) / max(whole, 1),
        "images": sum(1 for _ in root.all("img")),
        "videos": sum(1 for _ in root.all("video")),
    }
