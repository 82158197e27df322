"""Linear classifiers of lines, fitted on labelled lines: how a line is worded, begins, ends and is built.

Two are fitted. *Furniture*: its labels come from the pages themselves. A line that stands in the same masked wording on several
pages of one site, or begins with a label that does, is furniture; a line of several words that stands once is text. *Residue*:
its labels are the exemplars of residue against lines of the corpus that no exemplar covers. Both can be fitted on all lines of a
corpus: each step of the descent is a pass over its lines, which are kept as numbers of features. The passes of a descent run in one
barrier stage, whose tasks read their lines once and exchange sums after each pass.
"""

from __future__ import annotations

import math
import os
import random
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.exemplars import Index, is_prose, mask, tokens
from leafwright.session import broadcast_if_small, cut, forget_shuffles, release, stored

#: Pages of a site in the sample that must hold a wording, or begin a line with a label, for it to count as furniture; words that a single line needs to count as text.
REPEATED, LABELLED, TEXT_WORDS = 3, 4, 6
#: Sentences of a page that is surely an article.
ARTICLE_SENTENCES = 4
#: Steps, their size, and the pull of weights towards nothing.
ROUNDS, RATE, PULL = 80, 0.5, 1e-5
#: What words, or the beginning of a line, must add to tell anything.
WORDED, BEGUN = 0.3, 0.5
#: Letters by which forms of a word are told to be one.
STEM = 5
#: Characters of a line in which a label before a colon may end.
LABEL = 40
#: Features on at least one of so many lines get a weight; so their number is at most that many times the features of a line on average.
ONE_OF = 100_000
#: Words of a task that are held before their counts move; most partitions of the lines that the descent passes over; lines whose features are numbered together.
HELD, PARTS, BLOCK = 500_000, 64, 10_000
#: Lines whose wording a task remembers, and their characters at most.
LINES, REMEMBERED = 100_000, 160
#: Bytes of sums that the tasks of a descent may send the first in a pass; beyond it each pass is a job of its own.
EXCHANGED = 512_000_000
#: Features of a line besides its words.
_KINDS = ("first", "second", "last", "end", "size", "parts", "label")
SHAPES = len(_KINDS)


def shape(masked: str, words: list[str]) -> list[tuple[str, str]]:
    """Features besides the words: how a line begins and ends, its size, and its separators."""
    head = masked[:LABEL]
    return [
        ("first", words[0]),
        ("second", " ".join(words[:2])),
        ("last", words[-1]),
        ("end", masked[-1] if not masked[-1].isalnum() else "a"),
        ("size", str(min(int(2 * math.log2(len(words) + 1)), 14))),
        ("parts", str(min(masked.count("|") + masked.count(">") + masked.count("·") + masked.count("/"), 3))),
        ("label", head.split(":")[0] if ":" in head else ""),
    ]


def with_stems(words: list[str]) -> set[str]:
    """Distinct words and the beginnings of the longer ones."""
    found = set(words)
    return found | {w[:STEM] + "~" for w in found if len(w) > STEM}


def features(masked: str, stems: bool) -> list[tuple[tuple[str, str], float]]:
    """Features of a line and what each counts; none for a line without words."""
    words = tokens(masked)
    if not words:
        return []
    part = 1 / math.sqrt(len(set(words)))
    return [*((("word", w), part) for w in (with_stems(words) if stems else set(words))), *((f, 1.0) for f in shape(masked, words))]


class Numbers(dict):
    """Numbers what it is asked for, from 0."""

    def __missing__(self, x: str) -> int:
        self[x] = n = len(self)
        return n


def _narrow(most: int) -> np.dtype:
    """The narrowest type of numbers up to ``most``."""
    return np.min_scalar_type(max(most, 0))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[len(ordered) > 0, ordered[1:] != ordered[:-1]][: len(ordered)])


class Block:
    """Lines as numbers of the features that stand in them."""

    SCHEMA = "names array<string>, counts array<long>, words binary, sizes binary, shapes binary, parts binary, labels binary, weights binary, size long, total double"

    def __init__(self, stems: bool) -> None:
        self.stems = stems
        self.numbers, self.kinds = Numbers(), [Numbers() for _ in range(SHAPES)]
        self.words: list[int] = []
        self.shapes: list[int] = []  # -1 for what a line lacks
        self.sizes: list[int] = []
        self.labels: list[float] = []
        self.weights: list[float] = []

    def add(self, masked: str, label: float, weight: float) -> None:
        """:func:`features` of a line; the stems follow in :meth:`row`."""
        words = tokens(masked)
        distinct = set(words)
        self.words += map(self.numbers.__getitem__, distinct)
        self.shapes += [of[x] for of, (_, x) in zip(self.kinds, shape(masked, words))] if words else [-1] * SHAPES
        self.sizes.append(len(distinct))
        self.labels.append(label)
        self.weights.append(weight)

    def row(self) -> pa.RecordBatch:
        words, sizes, names = np.array(self.words, dtype=np.int64), np.array(self.sizes, dtype=np.int64), ["word\t" + w for w in self.numbers]
        parts = 1 / np.sqrt(np.maximum(sizes, 1))
        if self.stems:
            of = Numbers()
            stem = np.array([of[w[:STEM] + "~"] if len(w) > STEM else -1 for w in self.numbers], dtype=np.int64)
            names += ["word\t" + x for x in of]
            line, own = np.repeat(np.arange(len(sizes)) * max(len(names), 1), sizes), stem[words]
            both = np.sort(np.concatenate([line + words, (line + own + len(self.numbers))[own >= 0]]))
            line, words = np.divmod(both[_starts(both)], max(len(names), 1))  # a stem counts once a line
            sizes = np.bincount(line, minlength=len(sizes))
        shapes = np.array(self.shapes, dtype=np.int64).reshape(-1, SHAPES)
        for k, of in enumerate(self.kinds):
            shapes[:, k] += np.where(shapes[:, k] >= 0, len(names), 0)
            kind = _KINDS[k] + "\t"
            names += [kind + x for x in of]
        counts = np.bincount(words, minlength=len(names)) + np.bincount(shapes[shapes >= 0], minlength=len(names))
        shapes[shapes < 0] = len(names)
        kind = _narrow(len(names))
        arrays = [words.astype(kind), sizes.astype(np.uint32), shapes.astype(kind), parts.astype(np.float32), np.array(self.labels, dtype=np.float32), np.array(self.weights, dtype=np.float64)]
        columns = [pa.array([names], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([len(sizes)]), pa.array([float(sum(self.weights))])]
        return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in self.SCHEMA.split(", ")])


class Slope:
    """Sums over lines of a task, which lie in a file as numbers of the features that count. Each block numbers its own features, by line and by feature."""

    def __init__(self, known: dict[str, int], file: tempfile._TemporaryFileWrapper) -> None:
        self.known, self.file = known, file
        self.blocks: list[list[tuple[int, int, np.dtype]]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            names = row["names"]
            to, kind = np.array([*(self.known.get(x, -1) for x in names), -1], dtype=np.int64), _narrow(len(names))  # a last one for shapes that a line lacks
            features = np.flatnonzero(to >= 0)
            n = len(features)
            own = np.full(len(to), n, dtype=np.int64)
            own[features] = np.arange(n)
            words, sizes = own[np.frombuffer(row["words"], dtype=kind)], np.frombuffer(row["sizes"], dtype=np.uint32)
            lines = np.repeat(np.arange(len(sizes)), sizes)[words < n]
            words = words[words < n]
            sizes = np.bincount(lines, minlength=len(sizes))
            shapes = own[np.frombuffer(row["shapes"], dtype=kind)].reshape(-1, SHAPES).T.ravel()  # kind by kind
            parts, labels, weights = np.frombuffer(row["parts"], dtype=np.float32), np.frombuffer(row["labels"], dtype=np.float32), np.frombuffer(row["weights"])
            of, at = np.concatenate([words, shapes]), np.concatenate([lines, len(sizes) + np.tile(np.arange(len(sizes)), SHAPES)])
            order = np.argsort(of, kind="stable")
            order = order[: np.searchsorted(of, n, sorter=order)]
            block = []
            arrays = (to[features].astype(np.int32), words.astype(_narrow(n)), sizes.astype(_narrow(int(sizes.max(initial=0)))), shapes.astype(_narrow(n)), at[order].astype(_narrow(2 * len(sizes))), _starts(of[order]).astype(np.int32), parts, labels, weights)
            for a in arrays:
                self.file.write(b"\0" * (-self.file.tell() % 8))
                block.append((self.file.tell(), len(a), a.dtype))
                self.file.write(a.tobytes())
            self.blocks.append(block)

    def __call__(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        out, rest = np.zeros(len(w)), 0.0
        self.file.flush()
        whole = np.memmap(self.file, dtype=np.uint8, mode="r") if self.blocks else None
        for block in self.blocks:
            features, words, sizes, shapes, at, starts, parts, labels, weights = (whole[a : a + n * kind.itemsize].view(kind) for a, n, kind in block)
            own, sums, odds = np.r_[w[features], 0.0], np.zeros(len(sizes)), np.full(len(sizes), bias)
            if len(words):
                some = np.flatnonzero(sizes)
                sums[some] = np.add.reduceat(own.take(words), (np.cumsum(sizes, dtype=np.int64) - sizes)[some])
            for k in range(SHAPES):
                odds += own.take(shapes[k * len(sizes) : (k + 1) * len(sizes)])
            odds += parts * sums
            off = (1 / (1 + np.exp(-odds)) - labels) * weights
            if len(at):
                out[features] += np.add.reduceat(np.concatenate([parts * off, off]).take(at), starts)
            rest += float(off.sum())
        return out, rest


class Exchange:
    """Sums over the tasks of a barrier stage. The first task adds up what the others send it; the stage's own gathering takes a second each time."""

    def __init__(self, task: BarrierTaskContext, key: bytes) -> None:
        self.others: list[Connection] = []
        hosts = [x.address.rsplit(":", 1)[0] for x in task.getTaskInfos()]
        if task.partitionId() == 0:
            with Listener(("", 0), backlog=len(hosts), authkey=key) as listener:
                task.allGather(str(listener.address[1]))
                found = [listener.accept() for _ in hosts[1:]]
            self.others = self._ordered(found)
            self.first = None
        else:
            self.first = Client((hosts[0], int(task.allGather("")[0])), authkey=key)
            self.first.send_bytes(str(task.partitionId()).encode())

    @staticmethod
    def _ordered(found: list[Connection]) -> list[Connection]:
        of = {int(x.recv_bytes()): x for x in found}
        return [of[i] for i in sorted(of)]

    def sum(self, mine: np.ndarray) -> np.ndarray:
        if self.first is not None:
            self.first.send_bytes(mine.tobytes())
            return np.frombuffer(self.first.recv_bytes())
        whole = mine.copy()
        for x in self.others:  # in the order of the tasks
            whole += np.frombuffer(x.recv_bytes())
        for x in self.others:
            x.send_bytes(whole.tobytes())
        return whole

    def close(self) -> None:
        for x in [*self.others, *([self.first] if self.first is not None else [])]:
            x.close()


def _local_file() -> tempfile._TemporaryFileWrapper:
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def _descent(n: int, total: float, slope: Callable[[np.ndarray, float], tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias; ``slope`` gives the sums over all lines for weights and a bias."""
    w, bias, spread = np.zeros(n), 0.0, np.full(n, 1e-6)
    for _ in range(ROUNDS if total > 0 else 0):
        whole, rest = slope(w, bias)
        each = whole / total + PULL * w
        spread += each * each
        w = w - RATE * each / np.sqrt(spread)
        bias -= RATE * rest / total
    return w, bias


class LineModel:
    """Weights of features; :meth:`score` is the log odds that a line belongs to the class."""

    def __init__(self, lines: list[str], labels: list[float], weights: list[float] | None = None, stems: bool = False):
        self.stems = stems
        names: dict[tuple[str, str], int] = {}
        row, column, value = [], [], []
        for i, masked in enumerate(lines):
            for f, v in features(masked, stems):
                row.append(i)
                column.append(names.setdefault(f, len(names)))
                value.append(v)
        y, each = np.array(labels), np.array(weights if weights is not None else np.ones(len(labels)))
        r, c, x = np.array(row, dtype=np.int64), np.array(column, dtype=np.int64), np.array(value)

        def slope(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
            off = (1 / (1 + np.exp(-(np.bincount(r, x * w[c], len(y)) + bias))) - y) * each
            return np.bincount(c, x * off[r], len(names)), float(off.sum())

        self._take(list(names), *_descent(len(names), float(each.sum()) if len(lines) else 0.0, slope))

    @classmethod
    def of_corpus(cls, lines: DataFrame, stems: bool = False, last: DataFrame | None = None) -> LineModel:
        """The model of all rows of ``lines`` (``line``, masked; ``label``, 1 or 0; ``n``, what it weighs). ``last`` is what they are read
        from, if nothing else reads it; it is released before the descent."""
        self = cls.__new__(cls)
        self.stems = stems
        context = lines.sparkSession.sparkContext
        scala = context._jsc.sc()
        slots = min(PARTS, scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile()))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(stems)
            for batch in batches:
                for line, label, n in zip(*(c.to_pylist() for c in batch.columns)):
                    block.add(line, label, n)
                    if len(block.sizes) >= BLOCK:
                        yield block.row()
                        block = Block(stems)
            if block.sizes:
                yield block.row()

        blocks = cut(lines.select("line", F.col("label").cast("double"), F.col("n").cast("double")).mapInArrow(packed, Block.SCHEMA).coalesce(max(1, slots)))
        if last is not None:
            release(last)
        forget_shuffles(lines.sparkSession)
        count, total = blocks.agg(F.sum("size"), F.sum("total")).first()
        least = (count or 0) / ONE_OF
        kept = blocks.select(F.explode(F.arrays_zip("names", "counts")).alias("x")).groupBy("x.names").agg(F.sum("x.counts").alias("n")).where(F.col("n") >= least)
        names = sorted(tuple(r.names.split("\t", 1)) for r in kept.toLocalIterator())
        known = context.broadcast({"\t".join(f): i for i, f in enumerate(names)})
        rows = blocks.drop("counts", "size", "total")

        key = os.urandom(32)

        def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = BarrierTaskContext.get()
            with _local_file() as file:
                own = Slope(known.value, file)
                for batch in batches:
                    own.add(batch)
                exchange = Exchange(task, key)

                def slope(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
                    whole = exchange.sum(np.r_[own(w, bias)])
                    return whole[:-1], float(whole[-1])

                w, bias = _descent(len(known.value), total, slope)
                exchange.close()
            if task.partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([float(bias)])], ["w", "bias"])

        def sums(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
            now = context.broadcast((w, bias))

            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                with _local_file() as file:
                    own = Slope(known.value, file)
                    for batch in batches:
                        own.add(batch)
                    out, rest = own(*now.value)
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([rest])], ["slope", "rest"])

            whole, rest = np.zeros(len(w)), 0.0
            for one in rows.mapInArrow(part, "slope binary, rest double").toArrow().to_pylist():
                whole += np.frombuffer(one["slope"])
                rest += one["rest"]
            now.destroy()
            return whole, rest

        if not total:
            w, bias = np.zeros(len(names)), 0.0
        elif context.getConf().get("spark.dynamicAllocation.enabled", "false") != "true" and 8 * len(names) * slots < EXCHANGED:
            found = rows.mapInArrow(rounds, "w binary, bias double", barrier=True).collect()[0]
            w, bias = np.frombuffer(found.w), found.bias
        else:
            w, bias = _descent(len(names), total, sums)
        self._take(names, w, bias)
        known.destroy()
        release(blocks)
        return self

    def _take(self, names: list[tuple[str, str]], w: np.ndarray, bias: float) -> None:
        self.bias = bias
        self.words: dict[str, float] = {}
        self.shapes: dict[tuple[str, str], float] = {}
        for k, f in enumerate(names):
            if f[0] == "word":
                self.words[f[1]] = float(w[k])
            else:
                self.shapes[f] = float(w[k])

    def of_words(self, words: list[str]) -> float:
        """What the words alone add."""
        if not words:
            return 0.0
        distinct, of = set(words), self.words
        found = sum([of[w] for w in distinct if w in of])
        if self.stems:
            found += sum([of[w] for w in {w[:STEM] + "~" for w in distinct if len(w) > STEM} if w in of])
        return found / math.sqrt(len(distinct))

    def familiar(self, words: list[str]) -> float:
        """Share of words that the model has seen, or their beginnings."""
        distinct = set(words)
        return sum([w in self.words or w[:STEM] + "~" in self.words for w in distinct]) / len(distinct) if distinct else 0.0

    def known_odds(self, masked: str, words: list[str]) -> float:
        """:meth:`score` of a line that has words, a beginning or a label that speak for the class, else 0; size and marks alone tell nothing."""
        if not words:
            return 0.0
        part, of = self.of_words(words), self.shapes.get
        if part < WORDED:
            head = masked[:LABEL]
            begun = max(of(("first", words[0]), 0.0), of(("second", " ".join(words[:2])), 0.0), of(("label", head.split(":")[0]), 0.0) if ":" in head else of(("label", ""), 0.0))
            if begun < BEGUN:
                return 0.0
        return self.bias + part + sum([of(f, 0.0) for f in shape(masked, words)])

    def score(self, masked: str, words: list[str], part: float | None = None) -> float:
        """``part`` is what the words alone add, if known."""
        if not words:
            return self.bias
        of = self.shapes.get
        return self.bias + (self.of_words(words) if part is None else part) + sum([of(f, 0.0) for f in shape(masked, words)])


def label_by_repetition(pages: list[tuple[str, str | None]]) -> tuple[list[str], list[float]]:
    """(masked line, 1 or 0) of the lines of (text, site) that their repetition tells; others are left out."""
    held: Counter[tuple[str | None, str]] = Counter()
    begun: Counter[tuple[str | None, str]] = Counter()
    whole: list[tuple[str | None, str]] = []
    for text, site in pages:
        name = site.replace("_", " ") if site else None
        own = [mask(x, name) for x in text.split("\n") if x and not x.isspace()]
        whole += [(site, m) for m in own]
        held.update({(site, m) for m in own})
        begun.update({(site, m[:LABEL].split(":")[0]) for m in own if ":" in m[:LABEL]})
    lines, labels = [], []
    for site, m in whole:
        if site is not None and (held[site, m] >= REPEATED or ":" in m[:LABEL] and begun[site, m[:LABEL].split(":")[0]] >= LABELLED):
            lines.append(m)
            labels.append(1.0)
        elif held[site, m] == 1 and len(tokens(m)) >= TEXT_WORDS:
            lines.append(m)
            labels.append(0.0)
    return lines, labels


def furniture_model(pages: list[tuple[str, str | None]]) -> LineModel:
    return LineModel(*label_by_repetition(pages))


#: Beginnings of lines by site up to which they are broadcast.
BEGINNINGS = 100_000


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(``line``, ``label``, ``n``): :func:`label_by_repetition` of all ``pages`` (``t``, ``s``), equal lines of one label as one row."""
    return _labelled(lines_and_heads(pages))


def furniture_model_of(pages: DataFrame) -> LineModel:
    """:func:`furniture_model` of all ``pages`` (``t``, ``s``)."""
    return furniture_model_of_lines(lines_and_heads(pages))


def furniture_model_of_lines(both: DataFrame) -> LineModel:
    """:func:`furniture_model_of` from :func:`lines_and_heads`, which are released."""
    return LineModel.of_corpus(_labelled(both), last=both)


def lines_and_heads(pages: DataFrame) -> DataFrame:
    """By site the masked lines, how many pages hold them and how often; and, without a line, the labels that lines begin with."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str | None], tuple[str, int]] = {}  # masked wording and number of words of lines
        for batch in batches:
            rows = []
            for text, site in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, held, size = site.replace("_", " ") if site else None, {}, {}
                for x in text.split("\n"):
                    if x and not x.isspace():
                        found = seen.get((x, name))
                        if found is None:
                            masked = mask(x, name)
                            found = masked, len(tokens(masked))
                            if len(x) <= REMEMBERED:
                                seen[x, name] = found
                        masked, size[masked] = found
                        held[masked] = held.get(masked, 0) + 1
                heads = {m: m[:LABEL].split(":")[0] for m in held if ":" in m[:LABEL]}
                rows += [(site, m, heads.get(m), size[m], n) for m, n in held.items()]
                rows += [(site, None, h, None, 1) for h in set(heads.values()) if site is not None]
                if len(seen) > LINES:
                    seen.clear()
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["s", "line", "head", "words", "n"])

    return stored(pages.select("t", "s").mapInArrow(own, "s string, line string, head string, words long, n long").groupBy("s", "line", "head", "words").agg(F.count("*").alias("held"), F.sum("n").alias("n")))


def _labelled(both: DataFrame) -> DataFrame:
    lines = both.where(F.col("line").isNotNull())
    begun = both.where(F.col("line").isNull() & (F.col("held") >= LABELLED)).select("s", "head", F.lit(True).alias("begun"))
    told = lines.join(broadcast_if_small(begun, BEGINNINGS), ["s", "head"], "left")
    furniture = F.col("s").isNotNull() & ((F.col("held") >= REPEATED) | F.col("begun").isNotNull())
    label = F.when(furniture, 1.0).when((F.col("held") == 1) & (F.col("words") >= TEXT_WORDS), 0.0)
    return told.select("line", label.alias("label"), "n").where(F.col("label").isNotNull()).groupBy("line", "label").agg(F.sum("n").cast("double").alias("n"))


def article_part(masked: list[str], covered: Callable[[str], bool]) -> list[str]:
    """The masked lines of a page that exemplars don't cover, if several sentences are among them; such pages are surely articles."""
    if sum(map(is_prose, masked)) < ARTICLE_SENTENCES:
        return []
    own = [m for m in masked if not covered(m)]
    return own if sum(map(is_prose, own)) >= ARTICLE_SENTENCES else []


def article_lines(pages: list[tuple[str, str | None]], index: Index, covered: float) -> list[str]:
    """Distinct masked lines, not covered by ``index``, of the pages with several sentences that it doesn't cover either."""
    out: dict[str, None] = {}
    for text, site in pages:
        name = site.replace("_", " ") if site else None
        out.update(dict.fromkeys(article_part([mask(x, name) for x in text.split("\n") if x and not x.isspace()], lambda m: index.best(tokens(m))[0] >= covered)))
    return list(out)


def _positives(exemplars: list[str], seed: int) -> list[str]:
    r = random.Random(seed)
    return [mask(e.replace("…", r.choice(["", "index.html", "/a/b/7", "x"])).replace("#", str(r.randint(1, 999))), None) for e in exemplars]


def residue_model(articles: list[str], exemplars: list[str], seed: int = 5) -> LineModel:
    """Exemplars, with numbers filled in, against lines of articles, both sides weighing the same."""
    positives = _positives(exemplars, seed)
    weigh = len(articles) / max(len(positives), 1)
    return LineModel(positives + articles, [1.0] * len(positives) + [0.0] * len(articles), [weigh / 2] * len(positives) + [1.0] * len(articles), stems=True)


def residue_model_of(articles: DataFrame, exemplars: list[str], seed: int = 5, last: bool = False) -> LineModel:
    """:func:`residue_model` against the distinct lines ``articles`` (``line``) of all articles, which are read twice; if this is the ``last`` time,
    they are released."""
    positives = _positives(exemplars, seed)
    weigh = articles.count() / max(len(positives), 1)
    ours = articles.sparkSession.createDataFrame([(x, 1.0, weigh / 2) for x in positives], "line string, label double, n double").coalesce(1)
    return LineModel.of_corpus(articles.select("line", F.lit(0.0).alias("label"), F.lit(1.0).alias("n")).union(ours), stems=True, last=articles if last else None)
