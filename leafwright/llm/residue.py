"""Template residue, filler and error-page text.

Labelled exemplars of residue and of page furniture stand in an inverted index. The passage windows of a page are its lines, the
sentences of a line, and lines in a row that no exemplar covers alone. For each window the exemplars that share a token are
retrieved, and the containment of its TF-IDF mass in the best of them is taken; document frequencies are those of the
corpus. Windows that no exemplar covers are judged by a classifier that is fitted on the exemplars against lines of articles, so
that other wordings of the same notices are known, too. A page is residue if windows of high coverage by residue stand on it
and no window of prose is left uncovered.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm import encoding, linemodel
from leafwright.llm.encoding import Model
from leafwright.llm.exemplars import FILLER, FURNITURE, FURNITURE_GENERAL, HAN_FILLER, LIST_HEADINGS, MENU, RESIDUE, RESIDUE_GENERAL, SIGNATURES, Fill, Index, is_prose, mask, sentences, tokens
from leafwright.session import cut, release, stored

#: Containment from which a window counts as covered; share of a window's words that slots must be; log odds from which the classifier counts as coverage.
COVERED, SLOTTED, LIKELY = 0.66, 0.15, -1.0
#: Share of a window's words that the classifier must know.
FAMILIAR = 1 / 3
#: Log odds a character from which new words count as filler.
FILLING = 0.22
#: Uncovered windows of so many characters (Han: a third) read as text even without a mark at their end.
LONG = 90
#: Lines in a row that make up one window.
ROW = 3
CACHE, WINDOWS = 200_000, 50_000
#: Characters of a line up to which it is remembered for its repetition.
SHORT = 160
#: Words on at least one of so many documents are frequent; so their number is at most that many times the words of a document on average.
FREQUENT = 1000

_MARKS = re.compile(r"[\W_]+")


@dataclass
class Fitted:
    """What is fitted on a corpus: its wrong encodings, the classifiers of lines, filler, and its frequent words. Any may be missing."""

    encodings: Model | None = None
    residue: linemodel.LineModel | None = None
    furniture: linemodel.LineModel | None = None
    fill: Fill | None = None
    frequent: dict[str, float] | None = field(default=None, repr=False)
    rare: float | None = None


def labelled(residue: list[str] | None = None, furniture: list[str] | None = None) -> dict[str, list[str]]:
    return {"residue": [*RESIDUE, *RESIDUE_GENERAL] if residue is None else residue, "furniture": [*FURNITURE, *FURNITURE_GENERAL] if furniture is None else furniture, "heading": LIST_HEADINGS, "signature": SIGNATURES}


def bags() -> dict[str, list[str]]:
    return {"residue": [*FILLER, " ".join(a + b for a in HAN_FILLER for b in HAN_FILLER)]}


def frequent_words(df: DataFrame, text: str, one_of: int = FREQUENT) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the words, and pairs of Han characters, on at least one of ``one_of`` documents, and that of all others.

    All documents count. Words are reduced to distinct ones of a document and counted on the map side; what reaches the driver is bounded as
    told at :data:`FREQUENT`.
    """
    low = F.lower(F.col(text))
    words = F.regexp_extract_all(low, F.lit("[\\p{L}&&[^\\p{IsHan}]]+"), F.lit(0))
    pairs = F.regexp_extract_all(low, F.lit("(?=(\\p{IsHan}\\p{IsHan}))"), F.lit(1))
    n = df.where(F.length(text) > 0).count()
    each = df.where(F.length(text) > 0).select(F.explode(F.array_distinct(F.concat(words, F.when(low.rlike("\\p{IsHan}"), pairs).otherwise(F.array().cast("array<string>"))))).alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") * one_of >= n)
    return {r.w: math.log(1 + n / r.c) for r in counts.toLocalIterator()}, math.log(1 + max(min(n, one_of), 1))


def distinct_pages(df: DataFrame, text: str, site: str) -> DataFrame:
    """(``t``, ``s``): the distinct texts that aren't empty, each with one of its sites."""
    return df.select(F.col(text).alias("t"), F.col(site).alias("s")).where(F.length("t") > 0).groupBy("t").agg(F.min("s").alias("s"))


def words_and_articles(pages: DataFrame, index: Index, encodings: Model) -> DataFrame:
    """(``line``, ``w``, ``n``): a row each for the masked lines of articles in ``pages`` (``t``, ``s``), which may repeat, and for how many of some
    pages hold a word ``w``; words of lines that read as garbled don't count."""
    shared, model = pages.sparkSession.sparkContext.broadcast(index), pages.sparkSession.sparkContext.broadcast(encodings)

    def rows(lines: list[str], held: Counter[str]) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.array([*lines, *[None] * len(held)], pa.string()), pa.array([*[None] * n, *held], pa.string()), pa.array([*[None] * n, *held.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["line", "w", "n"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, told = shared.value, Counter(), {}
        seen: dict[str, tuple[str, list[str]]] = {}  # masked wording, without a site, and words of lines
        words_of: dict[str, list[str]] = {}  # of a page's lines

        def covered(masked: str) -> bool:
            if masked not in told:
                told[masked] = own.best(words_of[masked] if masked in words_of else tokens(masked))[0] >= COVERED
            return told[masked]

        for batch in batches:
            out: dict[str, None] = {}
            texts, sites, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(texts):
                start, size, asked = at, 0, {}
                while at < len(texts) and size < encoding.BATCH_CHARACTERS:
                    size += len(texts[at])
                    asked.update(dict.fromkeys(x for x in texts[at].split("\n") if not x.isascii()) if not texts[at].isascii() else {})
                    at += 1
                odd = {x for x, strange in zip(asked, model.value.odd(list(asked))) if strange}
                for text, site in zip(texts[start:at], sites[start:at]):
                    name, masked, words = site.replace("_", " ") if site else None, [], set()
                    words_of.clear()
                    for x in text.split("\n"):
                        if x and not x.isspace():
                            if x in seen:
                                plain, its = seen[x]
                            else:
                                plain = mask(x, None)
                                its = tokens(plain)
                                if len(x) <= SHORT:
                                    seen[x] = plain, its
                            words_of[plain] = its
                            masked.append(plain.replace(name, "@") if name else plain)
                            if "�" not in x and x not in odd:
                                words.update(its)
                    held.update(words)
                    out.update(dict.fromkeys(linemodel.article_part(masked, covered)))
                if len(told) > CACHE:
                    told.clear()
                if len(seen) > WINDOWS:
                    seen.clear()
            if len(held) > linemodel.HELD:
                yield rows([], held)
                held.clear()
            yield rows(list(out), Counter())
        yield rows([], held)

    return stored(pages.select("t", "s").mapInArrow(found, "line string, w string, n long"))


def fill_of(counts: DataFrame, pages: int) -> Fill:
    """What tells filler from how many of all ``pages`` hold each word (``w``, ``n``)."""
    least = Fill.least(pages)
    found = counts.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return Fill.of_counts({r.w: r.n for r in found.orderBy("w").toLocalIterator()}, least)


def fit(df: DataFrame, text: str, site: str, words: bool = True, furniture: bool = True) -> Fitted:
    """Models of a corpus with columns ``text`` and ``site``, on all its distinct texts; word frequencies and the model of furniture only if asked for."""
    pages = stored(distinct_pages(df, text, site))
    frequent, rare = frequent_words(df, text) if words else (None, None)
    out = Fitted(encoding.fit(pages, "t", distinct=True), frequent=frequent, rare=rare)
    index = Index(labelled(), bags=bags(), frequent=frequent, rare=rare)
    both = words_and_articles(pages, index, out.encodings)
    out.fill = fill_of(both.where(F.col("w").isNotNull()).select("w", "n"), pages.count())
    articles = stored(both.where(F.col("line").isNotNull()).select("line").distinct())
    release(both)
    lines = linemodel.lines_and_heads(pages) if furniture else None
    release(pages)  # the descents need room
    if lines is not None:
        out.furniture = linemodel.furniture_model_of_lines(lines)
    out.residue = linemodel.residue_model_of(articles, labelled()["residue"], last=True)
    return out


class Windows:
    """Masked wording, words and cover of lines, remembered, so that several judges of a page work them out once."""

    def __init__(self, fitted: Fitted, exemplars: dict[str, list[str]] | None = None) -> None:
        self.index = Index(exemplars or labelled(), bags=bags(), frequent=fitted.frequent, rare=fitted.rare)
        self.seen: dict[tuple[str, str | None], tuple[str, list[str], tuple[float, str] | None]] = {}

    def of(self, line: str, name: str | None, keep: bool = False) -> tuple[str, list[str], tuple[float, str] | None]:
        """Masked wording, words and cover of a line; only what is to be kept is covered at once."""
        found = self.seen.get((line, name))
        if found is None:
            masked = mask(line, name)
            words = tokens(masked)
            found = masked, words, self.index.best(words) if keep else None
            if keep:
                self.seen[line, name] = found
        return found

    def trim(self) -> None:
        """Forgets all if too much is remembered; lines of a batch stay together."""
        if len(self.seen) > WINDOWS:
            self.seen.clear()


class Judge:
    """Labels of windows, remembered by their masked wording."""

    def __init__(self, fitted: Fitted | None = None, exemplars: dict[str, list[str]] | None = None, windows: Windows | None = None) -> None:
        self.fitted = fitted or Fitted()
        self.model = self.fitted.encodings
        self.windows = windows or Windows(self.fitted, exemplars)
        self.index = self.windows.index
        self.menu = set(MENU)
        self.known: dict[str, str] = {}

    def label(self, masked: str, words: list[str] | None = None, cover: tuple[float, str] | None = None) -> str:
        """``residue``, ``furniture``, ``prose`` or ``other`` (headlines, menus); a window's words and how exemplars cover it may be given."""
        if masked in self.known:
            return self.known[masked]
        if len(self.known) > CACHE:
            self.known.clear()
        out = self._label(masked, tokens(masked) if words is None else words, cover)
        if len(masked) <= 160:
            self.known[masked] = out
        return out

    def _covered(self, masked: str, words: list[str], cover: tuple[float, str] | None = None) -> str:
        """Label of a window that its slots, exemplars or filler cover, else an empty string."""
        slots = words.count("⟨slot⟩")
        if slots:
            plain = [w for w in words if w not in ("#", "@", "©")]
            letters = len(plain) - slots
            if not letters or slots >= 2 and slots >= SLOTTED * len(plain) or letters <= 2:
                return "residue"
        containment, label = self.index.best(words) if cover is None else cover
        if containment >= COVERED:
            return "residue" if label == "residue" else "furniture"
        return "residue" if self.fitted.fill and "�" not in masked and self.fitted.fill.odds(words) >= FILLING else ""

    def _label(self, masked: str, words: list[str], cover: tuple[float, str] | None) -> str:
        if not any(w not in ("#", "@", "©", "⟨slot⟩") for w in words) and "⟨slot⟩" not in words and _repeats(masked):
            return "residue"
        if found := self._covered(masked, words, cover):
            return found
        prose = is_prose(masked)
        part = self.fitted.residue.of_words(words) if self.fitted.residue and (prose or len(words) > 2) else 0.0
        if (prose or len(words) > 2) and self._likely(masked, words, part):
            return "residue"
        if prose and part >= 0 and (found := self._passage(masked)):
            return found
        if prose:
            return "prose"
        han = sum("㐀" <= c <= "鿿" for c in masked)
        if len(masked) + 2 * han >= LONG and not self._menu(masked):
            return "prose"
        return "other"

    def _passage(self, masked: str) -> str:
        """Label of a line whose every sentence is covered, else an empty string."""
        parts, label = sentences(masked), "furniture"
        if len(parts) < 2:
            return ""
        for part in parts:
            words = tokens(part)
            found = self._covered(part, words) or ("residue" if self._likely(part, words) else "")
            if not found:
                return ""
            label = "residue" if found == "residue" else label
        return label

    def _likely(self, masked: str, words: list[str], part: float | None = None) -> bool:
        """Whether the classifier takes a window for residue, by its words (``part`` is what they add, if known) and altogether; words that it doesn't know tell nothing."""
        model = self.fitted.residue
        if model is None or "�" in masked:  # what lost its characters has no words
            return False
        part = model.of_words(words) if part is None else part
        return part >= linemodel.WORDED and model.score(masked, words, part) >= LIKELY and model.familiar(words) >= FAMILIAR

    def _menu(self, masked: str) -> bool:
        parts = [p.strip() for p in re.split(r"[|/·>]", masked)]
        return sum(p in self.menu for p in parts) >= max(2, len(parts) - 1) or sum(w in self.menu for w in masked.split()) >= 0.6 * len(masked.split())

    def residue(self, text: str | None, site: str | None, spans: dict[str, list] | None = None) -> tuple[bool, str | None]:
        """Whether a text is residue, and the window of prose, or an odd window in other letters, that speaks against it or leaves it open.
        With ``spans``, the labels of garbled lines, these are judged by their original wording."""
        if not text or text.isspace():
            return False, None
        name = site.replace("_", " ") if site else None
        hit, odd = False, None
        for line in sorted(text.split("\n"), key=len, reverse=True):  # the longest are the likeliest to be prose, which settles a page
            if not line or line.isspace():
                continue
            found = self.label(*self.windows.of(line, name, True))
            if spans is not None and found in ("prose", "other") and line in spans and (mended := self.model.mend(line, spans[line])):
                found = self.label(mask(mended, name))
            if found == "prose":
                return False, line
            if found == "other" and odd is None and not line.isascii():
                odd = line
            hit = hit or found == "residue"
        return (True, None) if hit or self._rows(text, name) else (False, odd)

    def _rows(self, text: str, name: str | None) -> bool:
        """Whether lines in a row that nothing covers alone are residue together."""
        run: list[str] = []
        for line in [*text.split("\n"), ""]:
            masked = self.windows.of(line, name)[0] if line and not line.isspace() else ""
            if masked and self.label(masked) == "other":
                run = [*run, masked][-ROW:]
                for n in range(2, len(run) + 1):
                    joined = " ".join(run[-n:])
                    if self._covered(joined, tokens(joined)) == "residue":
                        return True
            else:
                run = []
        return False

    def batch(self, texts: list[str | None], sites: list[str | None]) -> list[bool]:
        """:meth:`residue` of many texts; those settled or left open by an odd window are judged again by their original wording."""
        self.windows.trim()
        found = [self.residue(t, s) for t, s in zip(texts, sites)]
        if self.model:
            asked = [i for i, (_, line) in enumerate(found) if line and not line.isascii()]
            asked = [i for i, odd in zip(asked, self.model.odd([found[i][1] for i in asked])) if odd]
            lines = list(dict.fromkeys(x for i in asked for x in texts[i].split("\n") if not x.isascii()))
            spans = dict(zip(lines, self.model.label(lines)))
            for i in asked:
                found[i] = self.residue(texts[i], sites[i], spans)
        return [x for x, _ in found]


def _repeats(masked: str) -> bool:
    """Five or more of the same mark, or of the same group of marks."""
    groups = masked.split()
    marks = _MARKS.match(masked)
    if not marks:
        return False
    return (len(groups) >= 4 and len(set(groups)) <= 2) or (len(masked) >= 5 and len(set(masked) - {" "}) == 1)


def residue_pages(df: DataFrame, key: str, text: str, site: str | None = None, fitted: Fitted | None = None) -> DataFrame:
    """(``key``): the distinct keys of the pages whose text is residue beside furniture and headlines.

    Null, empty and blank texts are none. ``site`` names the column with the site, whose name in a text counts as known;
    it may be null. With ``fitted`` models, garbled lines are judged by their original wording and other wordings of notices are known. Whole texts are read;
    other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def judge(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = Judge(shared.value)
        for batch, sites in texts:
            yield pd.Series(own.batch(list(batch), list(sites)), dtype=bool)

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), (F.col(site) if site else F.lit(None).cast("string")).alias("_site")).where(F.length("_text") > 0)
    return rows.where(F.pandas_udf(judge, T.BooleanType())("_text", "_site")).select(F.col("_key").alias(key)).distinct()


def exclude_residue(df: DataFrame, key: str, text: str, site: str | None = None, fitted: Fitted | None = None) -> DataFrame:
    """``df`` without the rows whose key names a residue page; rows with a null key stay."""
    gone = cut(residue_pages(df, key, text, site, fitted).withColumnRenamed(key, "_gone"))
    return df.join(gone, df[key] == gone["_gone"], "left_anti")
