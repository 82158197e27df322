"""Page boilerplate mixed with main content.

The lines of a page are the nodes of a graph. A classifier gives each line the cost of calling it boilerplate and of
calling it content, its capacities to the two terminals: by the kind of line that exemplars and form tell, and by the log odds of a
linear model that is fitted on how lines repeat within sites. Neighbouring lines are joined by smoothness edges, whose
capacity grows with their proximity: lines of one block, lines of the same kind, the heading of a list and what
follows it. The minimum cut separates content from boilerplate. The graph of a page is a path, so the maximum flow
is found by pushing each node's excess on to the next as far as the edge carries it, in one pass.

Where pages tell their section, a first cut of all pages gives, for each site and section, how often a kind of line is boilerplate
before, inside and behind the article; these rates move the costs of unsure kinds before the final cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.exemplars import LIST_HEADINGS, MENU, is_prose, mask, sentences, tokens
from leafwright.llm.residue import CACHE, COVERED, SHORT, Fitted, Judge, Windows

#: Cost of calling a line content less that of calling it boilerplate, by kind; positive pulls towards boilerplate.
COSTS = {"furniture": 6.0, "heading": 6.0, "menu": 6.0, "menu word": 4.0, "slot": 5.0, "notice": 2.5, "numbered": 2.5, "headline": -1.0, "entry": 0.8, "bullet": -4.0, "signature": -6.0, "image": -6.0, "prose": -6.0, "title": -5.0, "long": -2.0}
#: Capacities of edges: any neighbours, headlines in a row, a heading and a headline, menu words in a row; share left over a blank line.
EDGE, ROW, LIST, MENU_ROW, GAP = 0.2, 2.5, 5.0, 5.0, 0.9

#: What a line's log odds of furniture, from ``DOUBT`` on, add to the cost of an unsure kind, and the most they count.
GAIN, DOUBT, MOST = 2.0, 1.0, 6.0
#: Unreadable lines of more characters than that pass for prose.
LOST_PROSE = 48
#: Kinds that garbled furniture or the page's own title may be taken for; kinds of lines that a heading inside the article heads.
UNSURE, HEADED = {"headline", "numbered", "long", "prose"}, {"prose", "bullet", "image", "signature", "long"}
#: Kinds that may stand between a heading and what it heads.
PASSED = {"furniture", "menu", "menu word", "notice", "slot"}

_NUMBERED = re.compile(r"^#[.)、] ?\S")
_IMAGE = re.compile(r"^\[\[img_#\]\]$")
_PARTS = re.compile(r" *[|/·>•｜] *")


def min_cut(costs: list[float], edges: list[float]) -> list[bool]:
    """Boilerplate side of the minimum cut of a path.

    ``costs[i]`` > 0 is node i's capacity from the boilerplate terminal, < 0 its capacity to the content terminal;
    ``edges[i]`` joins nodes i and i + 1. What flow a node can't pass to its own terminals is pushed along the edge to the
    next, at most its capacity; a saturated edge separates, across any other a node goes with its successor.
    """
    excess, pushed = [], 0.0
    for i, c in enumerate(costs):
        total = c + pushed
        excess.append(total)
        if i < len(edges):
            pushed = max(-edges[i], min(edges[i], total))
    side = [False] * len(costs)
    for i in range(len(costs) - 1, -1, -1):
        if i < len(edges) and abs(excess[i]) <= edges[i]:
            side[i] = side[i + 1]
        else:
            side[i] = excess[i] > 0
    return side


#: Kinds of lines that the labels of exemplars stand for.
KIND = {"residue": "notice", "furniture": "furniture", "heading": "heading", "signature": "signature"}


class Classifier:
    """Kinds of lines and what the model adds to their costs, remembered by their masked wording."""

    def __init__(self, fitted: Fitted | None = None, exemplars: dict[str, list[str]] | None = None, menu: list[str] = MENU, windows: Windows | None = None) -> None:
        fitted = fitted or Fitted()
        self.model, self.odds = fitted.encodings, fitted.furniture
        self.windows = windows or Windows(fitted, exemplars)
        self.menu, self.headings = set(menu), set(LIST_HEADINGS if exemplars is None else exemplars["heading"])
        self.phrases = sorted((m for m in self.menu if " " in m), key=len, reverse=True)
        self.known: dict[str, tuple[str, float]] = {}
        self.seen: dict[tuple[str, str | None], tuple[str, str, float]] = {}

    def kind(self, masked: str, words: list[str] | None = None, cover: tuple[float, str] | None = None) -> tuple[str, float]:
        """Kind of a line and what is added to that kind's cost; its words and how exemplars cover it may be given."""
        found = self.known.get(masked)
        if found is None:
            if len(self.known) > CACHE:
                self.known.clear()
            words = tokens(masked) if words is None else words
            found = self._kind(masked, words, self.windows.index.best(words) if cover is None else cover)
            if len(masked) <= 160:
                self.known[masked] = found
        return found

    def _kind(self, masked: str, words: list[str], cover: tuple[float, str]) -> tuple[str, float]:
        if _IMAGE.match(masked):
            return "image", 0.0
        if masked in self.headings:
            return "heading", 0.0
        if masked in self.menu:
            return "menu word", 0.0
        if masked.startswith("- "):
            return "bullet", 0.0
        slots = words.count("⟨slot⟩")
        if slots and len([w for w in words if w not in ("⟨slot⟩", "#", "@")]) <= 2 * slots:
            return "slot", 0.0
        if cover[0] >= COVERED:
            return KIND[cover[1]], 0.0
        odds = self.odds.known_odds(masked, words) if self.odds and "�" not in masked else 0.0
        more = GAIN * min(max(odds - DOUBT, 0.0), MOST)
        if is_prose(masked):
            if more and len(parts := sentences(masked)) > 1:  # a passage whose every sentence is furniture
                each = [self.windows.index.best(tokens(p)) for p in parts]
                if all(c >= COVERED for c, _ in each):
                    return KIND[each[0][1]], 0.0
            return "prose", more
        if self._menu(masked):
            return "menu", 0.0
        if _NUMBERED.match(masked):
            return "numbered", 0.0
        han = sum("㐀" <= c <= "鿿" for c in masked)
        return ("long" if len(masked) + 2 * han > 130 else "headline"), more

    def _menu(self, masked: str) -> bool:
        parts = _PARTS.split(masked)
        if len(parts) < 3:
            rest = masked
            for p in self.phrases:
                rest = rest.replace(p, p.replace(" ", "_"))
            parts = [w.replace("_", " ") for w in rest.split()]
        known = sum(p in self.menu for p in parts)
        return known >= 2 and known >= len(parts) - 1

    def batch(self, texts: list[str | None], sites: list[str | None], titles: list[str | None]) -> list[list[int]]:
        """Per text the numbers, from 1, of the non-blank lines that aren't part of the article."""
        return [self._cut(lines, bool(title)) for lines, title in zip(self.lines(texts, sites, titles), titles)]

    def lines(self, texts: list[str | None], sites: list[str | None], titles: list[str | None]) -> list[list[list]]:
        """Per text its non-blank lines: number from 1, kind, whether a blank line is before it, and what is added to the kind's cost."""
        self.windows.trim()
        if len(self.seen) > CACHE:
            self.seen.clear()
        pages: list[list[list]] = []
        doubtful: list[list] = []
        for text, site, title in zip(texts, sites, titles):
            name = site.replace("_", " ") if site else None
            own = mask(title, name) if title else None
            lines, gap = [], False
            for i, x in enumerate((text or "").split("\n")):
                if not x or x.isspace():
                    gap = True
                    continue
                found = self.seen.get((x, name))
                if found is None:
                    masked, words, cover = self.windows.of(x, name)
                    found = masked, *self.kind(masked, words, cover)
                    if len(x) <= SHORT:
                        self.seen[x, name] = found
                masked, kind, more = found
                if kind in UNSURE:
                    if own and masked == own:
                        kind, more = "title", 0.0
                    elif self.model and not x.isascii():
                        doubtful.append([len(pages), len(lines), x, name])
                lines.append([i + 1, kind, gap, more])
                gap = False
            pages.append(lines)
        if doubtful:
            strange = [d for d, odd in zip(doubtful, self.model.odd([d[2] for d in doubtful])) if odd]
            for (p, k, x, name), spans in zip(strange, self.model.label([d[2] for d in strange])):
                mended = self.model.mend(x, spans)
                if mended:
                    pages[p][k][1], pages[p][k][3] = self.kind(mask(mended, name))
                else:
                    pages[p][k][3] = 0.0  # its words aren't its own
                    if mended == "" and pages[p][k][1] != "prose":
                        pages[p][k][1] = "long" if len(x) > LOST_PROSE else pages[p][k][1]
        return pages

    @staticmethod
    def _cut(lines: list[list], titled: bool) -> list[int]:
        kinds = [line[1] for line in lines]
        costs, edges = [], []
        first = titled
        for i, kind in enumerate(kinds):
            cost = COSTS[kind]
            after = kinds[i + 1] if i + 1 < len(kinds) else None
            if kind == "headline":  # what heads no text is an entry of a list, but for a page's own title
                headed = next((k for k in kinds[i + 1 :] if k not in PASSED), None)
                cost = COSTS["headline"] if headed in HEADED or not first else COSTS["entry"]
                first = True
            costs.append(cost + lines[i][3])
            if after:
                w = EDGE
                if after in ("headline", "numbered"):
                    w = LIST if kind == "heading" else ROW if kind in ("headline", "numbered") else MENU_ROW if kind == "menu word" else EDGE
                edges.append(w * (GAP if lines[i + 1][2] else 1.0))
        return [line[0] for line, cut in zip(lines, min_cut(costs, edges)) if cut]


def furniture_lines(df: DataFrame, key: str, text: str, site: str, title: str, fitted: Fitted | None = None) -> DataFrame:
    """(``key``, ``line_no``): the non-blank lines of each text that aren't part of the article.

    Pages that are residue have no article to separate and are left out; so are null and empty texts. ``site`` and
    ``title`` may be null. With ``fitted`` models, garbled lines are judged by their original wording, and lines that no exemplar knows by how such lines
    repeat. Rows of equal key and line count once. Whole texts are read; other columns are ignored.
    """

    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def label(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        windows = Windows(shared.value or Fitted())
        classifier, judge = Classifier(shared.value, windows=windows), Judge(shared.value, windows=windows)
        for texts, sites, titles in batches:
            texts, sites = list(texts), list(sites)
            gone = judge.batch(texts, sites)
            yield pd.Series(classifier.batch([None if g else t for t, g in zip(texts, gone)], sites, list(titles)))

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(site).alias("_site"), F.col(title).alias("_title")).where(F.length("_text") > 0)
    found = rows.select(F.col("_key").alias(key), F.explode(F.pandas_udf(label, T.ArrayType(T.IntegerType()))("_text", "_site", "_title")).alias("line_no"))
    return found.distinct()


def main_text(df: DataFrame, key: str, text: str, site: str, title: str, fitted: Fitted | None = None) -> DataFrame:
    """(``key``, ``text``): the article of each page, its lines in order; null texts stay null, residue pages become empty.

    One row per row of ``df``.
    """

    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def keep(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        windows = Windows(shared.value or Fitted())
        classifier, judge = Classifier(shared.value, windows=windows), Judge(shared.value, windows=windows)
        for texts, sites, titles in batches:
            texts, sites = list(texts), list(sites)
            residue = judge.batch(texts, sites)
            cut = [set(x) for x in classifier.batch([None if g else t for t, g in zip(texts, residue)], sites, list(titles))]
            out = [t if t is None else "" if g else "\n".join(x for i, x in enumerate(t.split("\n")) if i + 1 not in c).strip("\n") for t, g, c in zip(texts, residue, cut)]
            yield pd.Series(out, dtype=object)

    return df.select(F.col(key).alias(key), F.pandas_udf(keep, T.StringType())(F.col(text), F.col(site), F.col(title)).alias(text))
