"""The article of a page as plain text with image placeholders, as Markdown, and its images."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from leafwright.pages.dom import BLANKS, BLOCKS, HIDDEN, Node, select, select_all
from leafwright.pages.readable import link_share, readable

# Containers of widespread publishing systems.
CONTAINERS = (("div.left_zw", "left_zw"), ("div.rm_txt_con", "rm_txt_con"), ("div#artibody", "artibody"), ('div[class^="index_text_"]', "index_text"))
IMAGE_SOURCES = ("src", "data-src", "data-original", "data-lazy-src")
BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:nav|menu|footer|sidebar|aside|share|social|related|recommend|comment|breadcrumb|cookie|advert|ads?|promo|subscribe|newsletter)(?:$|[\s_-])", re.I)
PHOTO_PARAGRAPH = re.compile(r"新华社.*摄|摄.*新华社", re.S)


@dataclass
class Body:
    lines: list[str] = field(default_factory=list)
    markdown: list[str] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return re.sub(r"\n{3,}", "\n\n", "\n".join(self.lines)).strip()

    @property
    def md(self) -> str:
        return re.sub(r"\n{3,}", "\n\n", "\n\n".join(self.markdown)).strip()


def _inline(node: Node) -> str:
    """Text of an element with code and formulas marked up."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(BLANKS.sub(" ", c))
        elif c.tag in HIDDEN or c.tag == "img":
            continue
        elif c.tag == "code":
            out.append(f"`{c.raw().strip()}`")
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "math":
            out.append(f"${BLANKS.sub(' ', c.raw()).strip()}$")
        else:
            out.append(_inline(c))
    return "".join(out)


def table_rows(table: Node, flags: list[str]) -> list[list[str]]:
    """Cells by row, padded to one width; a cell over several columns is followed by empty ones."""
    rows = []
    for tr in table.all("tr"):
        cells: list[str] = []
        for cell in (c for c in tr.walk() if c.tag in ("td", "th")):
            cells.append(cell.text())
            span = cell.attrs.get("colspan", "1")
            if "colspan" in cell.attrs or "rowspan" in cell.attrs:
                flags.append("table_colspan_flattened")
            cells += [""] * (min(int(span), 50) - 1 if span.isdigit() else 0)
        if cells:
            rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def markdown_table(rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def _image(body: Body, img: Node, caption: str | None = None) -> str:
    url = next((img.attrs[a].strip() for a in IMAGE_SOURCES if img.attrs.get(a, "").strip()), None)
    body.images.append({"type": "正文插图", "alt": img.attrs.get("alt", "").strip() or None, "caption": caption, "url": url, "width": img.attrs.get("width"), "height": img.attrs.get("height")})
    return f"[[IMG_{len(body.images)}]]"


def assemble(container: Node, captions: str | None = None, skip_boilerplate: bool = False) -> Body:
    """Blocks of a container in order. ``captions``: null leaves a figcaption in the text, ``figure`` moves it to its image,
    ``news_cn`` moves a paragraph that credits a photographer of the agency to the image before it."""
    body = Body()

    def put(text: str, markdown: str | None = None) -> None:
        text = text.strip()
        if text:
            body.lines.append(text)
            body.markdown.append((markdown or text).strip("\n").rstrip())

    def flush(parts: list[str]) -> None:
        put("\n".join(x for x in (BLANKS.sub(" ", p).strip() for p in "".join(parts).split("\n")) if x))
        parts.clear()

    def visit(node: Node, depth: int = 0, prefix: str = "") -> None:
        parts: list[str] = []
        for c in node.children:
            if isinstance(c, str):
                parts.append(BLANKS.sub(" ", c))
                continue
            if c.tag in HIDDEN or (skip_boilerplate and (c.tag in ("nav", "footer", "aside", "form") or BOILERPLATE.search(c.marks))):
                continue
            if c.tag == "img":
                flush(parts)
                put(_image(body, c))
            elif c.tag == "figure":
                flush(parts)
                caption = c.first("figcaption")
                words = caption.text() if caption is not None else None
                for img in c.all("img"):
                    put(_image(body, img, (words or None) if captions == "figure" else None))
                if words and (captions != "figure" or c.first("img") is None):
                    put(words)
            elif c.tag == "table":
                flush(parts)
                rows = table_rows(c, body.flags)
                if rows:
                    put("\n".join(" ".join(x for x in r if x) for r in rows[1:] if any(r)) or " ".join(rows[0]), markdown_table(rows))
            elif c.tag == "pre":
                flush(parts)
                language = re.search(r"language-([\w+-]+)", " ".join(n.attrs.get("class", "") for n in c.walk()))
                put(c.raw().strip("\n"), f"```{language.group(1) if language else ''}\n{c.raw().strip(chr(10))}\n```")
            elif re.fullmatch("h[1-6]", c.tag):
                flush(parts)
                put(c.text(), "#" * min(int(c.tag[1]) + 1, 6) + " " + c.text())
            elif c.tag in ("ul", "ol"):
                flush(parts)
                for i, li in enumerate([x for x in c.children if isinstance(x, Node) and x.tag == "li"], 1):
                    mark = f"{i}. " if c.tag == "ol" else "- "
                    own = BLANKS.sub(" ", "".join(_inline_part(x) for x in li.children if not (isinstance(x, Node) and x.tag in ("ul", "ol")))).strip()
                    put(own, "  " * depth + mark + own)
                    for img in li.all("img"):
                        put(_image(body, img))
                    for sub in (x for x in li.children if isinstance(x, Node) and x.tag in ("ul", "ol")):
                        visit(_wrap(sub), depth + 1)
            elif c.tag == "blockquote":
                flush(parts)
                before = len(body.markdown)
                visit(c, depth)
                body.markdown[before:] = ["> " + m.replace("\n", "\n> ") for m in body.markdown[before:]]
            elif c.tag in BLOCKS or c.first(*BLOCKS) is not None:
                flush(parts)
                text = c.text()
                if captions == "news_cn" and body.images and c.tag == "p" and PHOTO_PARAGRAPH.search(text) and body.lines and body.lines[-1].startswith("[[IMG_"):
                    body.images[-1]["caption"] = text
                else:
                    visit(c, depth)
            elif c.first("img") is not None:
                visit(c, depth)
            else:
                parts.append(_inline_part(c))
        flush(parts)

    visit(container)
    return body


def _wrap(node: Node) -> Node:
    root = Node("#root", {}, None)
    root.children.append(node)
    return root


def _inline_part(x: Node | str) -> str:
    return BLANKS.sub(" ", x) if isinstance(x, str) else "" if x.tag in HIDDEN or x.tag == "img" else _inline(_wrap(x))


def densest(root: Node, least: int = 200, most_links: float = 0.5) -> Node | None:
    """The container with the highest text length times number of paragraphs (ten count at most); the first of equals.

    Lengths, link lengths and paragraphs of all subtrees come from one pass from the leaves up.
    """
    sums: dict[int, tuple[int, int, int]] = {}
    order = list(root.walk())
    for n in reversed(order):
        text = links = paragraphs = 0
        if n.tag not in HIDDEN:
            for c in n.children:
                if isinstance(c, str):
                    text += len(BLANKS.sub(" ", c).strip())
                else:
                    t, l, p = sums[id(c)]
                    text, links, paragraphs = text + t, links + l, paragraphs + p
        if n.tag == "a":
            links = text
        sums[id(n)] = (text, links, paragraphs + (n.tag == "p"))
    best, found = 0, None
    for n in order:
        text, links, paragraphs = sums[id(n)]
        if n.tag in ("article", "div", "section", "td", "main") and text >= least and links <= most_links * text:
            score = text * min(paragraphs, 10)
            if score > best:
                best, found = score, n
    return found


def without(container: Node, dropped: tuple[str, ...]) -> Node:
    """A container without the elements of the given selectors."""
    gone = {id(n) for selector in dropped for n in select_all(container, selector)}

    def copy(node: Node) -> Node:
        kept = Node(node.tag, node.attrs, node.parent)
        kept.children = [c if isinstance(c, str) else copy(c) for c in node.children if isinstance(c, str) or id(c) not in gone]
        return kept

    return copy(container)


def main_content(root: Node, rule: tuple[str, str | None] | None = None, title: str | None = None) -> tuple[Body | None, str]:
    """(body, where from): the site's own container; a known publishing system's, if it is tighter than what reads like the main text;
    what reads like the main text, without a first line that repeats ``title``; the densest block."""
    if rule and (node := select(root, rule[0])) is not None:
        body = assemble(node, rule[1])
        if body.text:
            return body, "site_rules"
    main = readable(root)
    own = assemble(main, skip_boilerplate=True) if main is not None else None
    size = len("".join(own.text.split())) if own else 0
    for selector, label in CONTAINERS:
        node = select(root, selector)
        if node is not None:
            length = len("".join(node.text().split()))
            if length >= 60 and (not size or length < size) and (body := assemble(node)).text:
                return body, f"container:{label}"
    if own and own.text:
        if title and own.lines and " ".join(own.lines[0].split()) == title and len(own.lines) > 1:
            own.lines, own.markdown = own.lines[1:], own.markdown[1:]
        return own, "readable"
    node = densest(root)
    return (assemble(node, skip_boilerplate=True), "dom_density") if node is not None else (None, "none")
