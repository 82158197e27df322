"""Tools of those who annotate pages: evidence, candidate titles, strict times, and the text and Markdown of chosen containers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.pages import body, evidence
from leafwright.pages.decode import decode
from leafwright.pages.dom import Node, parse, select
from leafwright.pages.readable import candidates
from leafwright.pages.record import IMAGES

# Blanks that are squeezed, publishers at the end of titles, blocks that are lines, and the strict form of a time.
BLANKS = "[ \\t\\u00a0\\u3000]+"
PUBLISHERS = "新华网|新华社|中国政府网|Chinadaily\\.com\\.cn|China Daily|新浪|搜狐|网易|凤凰网|澎湃|财新|人民网|光明网|中国新闻网|CSDN|博客园|SegmentFault|澎湃新闻|cnBeta"
LINES = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption", "pre", "td", "th")
SOURCES = ("src", "data-src", "data-original")
STRICT_TIME = "^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2})(?::([0-9]{2}))?(?:\\.[0-9]+)?\\s*(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def norm_ws(text: Column) -> Column:
    """Runs of blanks, tabs, no-break and wide spaces as one blank; line feeds survive, but at the ends."""
    return F.regexp_replace(F.regexp_replace(text, BLANKS, " "), "^\\s+|\\s+$", "")


def clean_title(text: Column) -> Column:
    """A candidate title without one known publisher and what follows it at the end."""
    bare = F.regexp_replace(norm_ws(text), f"[_|｜—–-]\\s*(?:{PUBLISHERS})[^_|｜—–-]*$", "")
    return F.regexp_replace(bare, "^[ _|｜—–-]+|[ _|｜—–-]+$", "")


def iso_value(text: Column) -> Column:
    """(value, utc_offset) of a full ISO time to the minute or better, with both null for anything else."""
    t = F.regexp_replace(text, "^\\s+|\\s+$", "")
    part = lambda g: F.regexp_extract(t, STRICT_TIME, g)
    value = F.concat(part(1), F.lit(" "), part(2), F.lit(":"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("XX")))
    offset = F.when(part(4) == "Z", "+00:00").when(part(4) != "", F.concat(F.left(part(4), F.lit(3)), F.lit(":"), F.right(part(4), F.lit(2))))
    fits = F.coalesce(t.rlike(STRICT_TIME), F.lit(False))
    return F.struct(F.when(fits, value).alias("value"), F.when(fits, offset).alias("utc_offset"))


def text_with_images(container: Node) -> tuple[str, list[dict]]:
    """One line a leaf block, images as marks where they stand; a figure's caption goes to its image."""
    lines: list[str] = []
    images: list[dict] = []

    def mark(img: Node, caption: str | None = None) -> str:
        url = next((img.attrs[a] for a in SOURCES if img.attrs.get(a)), None)
        if not url:
            return ""
        images.append({"type": "正文插图", "alt": img.attrs.get("alt") or None, "caption": caption, "url": url, "width": img.attrs.get("width"), "height": img.attrs.get("height")})
        return f"[[IMG_{len(images)}]]"

    def inline(n: Node) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in ("script", "style") else f" {m} " if c.tag == "img" and (m := mark(c)) else "" if c.tag == "img" else inline(c) for c in n.children)

    def put(text: str) -> None:
        text = " ".join(text.replace("　", " ").replace("\xa0", " ").split(" ")).strip()
        text = " ".join(x for x in text.split(" ") if x)
        if text:
            lines.append(text)

    def visit(n: Node) -> None:
        if n.tag in ("script", "style"):
            return
        if n.tag == "figure" and (img := n.first("img")) is not None:
            caption = n.first("figcaption")
            put(mark(img, (caption.text() or None) if caption is not None else None))
        elif n.tag == "img":
            put(mark(n))
        elif n.tag in LINES and not any(d is not n and d.tag in LINES for d in n.walk()):
            put(inline(n))
        else:
            for c in n.children:
                if isinstance(c, Node):
                    visit(c)

    visit(container)
    return "\n".join(lines), images


@dataclass(frozen=True)
class Recipe:
    """Where a site's article stands and which parts of that don't belong to it."""

    site: str
    container: str
    dropped: tuple[str, ...] = ()


ANNOTATED = f"content_text string, content_md string, conversion_flags array<string>, images {IMAGES}"
EVIDENCE = (
    "title_tag string, headings array<string>, meta map<string, string>, json_ld array<string>, times array<struct<datetime: string, text: string>>, bylines array<string>, "
    "text_length int, links int, link_share double, images int, videos int"
)


def _per_page(pages: DataFrame, of, kind: str, *columns: str) -> Column:  # noqa: ANN001
    names = [x.split(" ")[0] for x in T._parse_datatype_string(kind).fieldNames()]

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([of(parse(decode(bytes(raw or b""))[0]), *rest) or dict.fromkeys(names) for raw, *rest in zip(*batch)], columns=names)

    return F.pandas_udf(run, T._parse_datatype_string(kind))(*columns)


def annotate(pages: DataFrame, recipes: tuple[Recipe, ...]) -> DataFrame:
    """(id, site, content_text, content_md, conversion_flags, images) of (id, site, raw) by each site's recipe; nulls where it has none or its container isn't there."""
    by_site = {r.site: r for r in recipes}

    def of(root: Node, site: str | None) -> dict | None:
        recipe = by_site.get(site or "")
        container = select(root, recipe.container) if recipe else None
        if container is None:
            return None
        own = body.without(container, recipe.dropped)
        text, images = text_with_images(own)
        full = body.assemble(own, "figure")
        return {"content_text": text or None, "content_md": full.md or None, "conversion_flags": sorted(set(full.flags)), "images": images}

    return pages.select("id", "site", _per_page(pages, of, ANNOTATED, "raw", "site").alias("_a")).select("id", "site", "_a.*")


def evidence_dump(pages: DataFrame) -> DataFrame:
    """(id, evidence of :data:`EVIDENCE`) of (id, raw): what an annotator is shown of a page."""
    return pages.select("id", _per_page(pages, lambda root, _: evidence.dump(root), EVIDENCE, "raw", "id").alias("_e")).select("id", "_e.*")


def content_candidates(pages: DataFrame) -> DataFrame:
    """(id, rank, tag, length, preview): the blocks of a page that may be its article, by their text's length; what a person or a model is asked to choose from."""
    kind = "array<struct<tag: string, length: int, preview: string>>"

    def run(raws: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in raws:
            yield pd.Series([[{"tag": n.tag, "length": size, "preview": n.text()[:120]} for n, size in candidates(parse(decode(bytes(raw or b""))[0]))] for raw in batch])

    each = F.posexplode(F.pandas_udf(run, T._parse_datatype_string(kind))("raw")).alias("_at", "c")
    return pages.select("id", each).select("id", (F.col("_at") + 1).alias("rank"), "c.*")
