"""Text that was decoded with the wrong character encoding.

A hidden Markov model labels the characters of a line. One state is clean text; one state stands for each
pair (written in, read in) of encodings; one for text that lost characters. Emissions are character bigrams,
backed off to single characters and Unicode blocks. They are counted over all lines of the corpus's distinct texts: each pair's
state on the lines put through the pair's wrong decoding, the clean state on the lines, and once more on what the
first model leaves of them. Most pairs turn each character into characters of its own, so their counts follow from those of the
corpus's bigrams; the others are counted on its words. Bigrams
of two ASCII characters are alike in all states, so only positions beside a character outside ASCII are
scored, and lines in plain ASCII are clean.

Each labelled span gets its state's inverse transform and the rest of its line stays as it is: a best-path search
over the line takes, place by place, either a character as it stands or the shortest stretch that a labelled state's
inverse turns into whole characters, whichever makes the line likelier as clean text. So spans end where bytes do, and one line
may hold spans of several states. A label stands only if its span gains by the inverse, or characters in it are plainly lost.
"""

from __future__ import annotations

import codecs
import math
import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.session import release, stored

# Pairs (written in, read in). "utf-8>cp1252" twice in a row is a pair of its own.
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "gb18030"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "cp850"),
    ("utf-8", "shift_jis"), ("utf-8", "big5"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"),
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("gb18030", "cp1252"),
    ("gb18030", "latin-1"), ("gb18030", "cp1251"), ("gb18030", "big5"), ("big5", "gb18030"), ("big5", "cp1252"), ("utf-8 twice", "cp1252"), ("utf-8 twice", "latin-1"),
]
STATES = ["clean", *[f"{w}>{r}" for w, r in PAIRS], "lost"]

#: Bounds of a :func:`sample`: distinct texts, their characters in all, and the longest text that is drawn.
SAMPLE_PAGES, SAMPLE_CHARACTERS, SAMPLE_LONGEST = 3000, 1_500_000, 20_000
TABLE = 1 << 17
#: Chance of leaving a state from one scored position to the next, and of a line's first state not being clean.
LEAVE, DIRTY = 1e-4, 5e-3
#: Mean log probability of a position from which a line isn't worth a closer look.
USUAL = -11.0
#: What restored text must gain in log probability; what a change between kept and restored characters costs, what more between two letters
#: and what more outside the words of labelled spans; what a kept character costs inside a labelled span.
MARGIN, CHANGE, WITHIN, APART, KEEP = 3.0, 1.5, 6.0, 9.0, 2.0
WEIGHTS = (0.80, 0.17, 0.03)  # bigram, character, block
#: Positions whose paths are searched side by side.
PATH_POSITIONS = 20_000
#: Characters of a batch that are labelled at once.
BATCH_CHARACTERS = 150_000

_C1 = {chr(i): bytes([i]) for i in range(0x80, 0xA0)}


def _pass(e: UnicodeError) -> tuple[bytes | str, int]:
    """Takes bytes that a Windows code page leaves open, and their characters, for each other."""
    part = e.object[e.start : e.end]
    if isinstance(e, UnicodeDecodeError):
        return part.decode("latin-1"), e.end
    if all(c in _C1 for c in part):
        return part.encode("latin-1"), e.end
    raise e


codecs.register_error("leafwright-pass", _pass)


def _read(data: bytes, encoding: str) -> str:
    """``data`` as a careless reader in ``encoding`` sees it: bytes that Windows code pages leave open pass through, others are lost."""
    if encoding in ("cp1252", "cp1251"):
        return data.decode(encoding, "leafwright-pass")
    return data.decode(encoding, "replace")


def _write(text: str, encoding: str) -> bytes:
    return text.encode(encoding, "leafwright-pass" if encoding in ("cp1252", "cp1251") else "strict")


def garble(text: str, pair: tuple[str, str]) -> str | None:
    """``text`` written in the pair's first encoding and read in its second; null if it can't be written so."""
    written, read = pair
    try:
        if written == "utf-8 twice":
            return _read(_read(text.encode("utf-8"), read).encode("utf-8"), read)
        return _read(_write(text, written), read)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def restore(text: str, state: str) -> str | None:
    """The inverse transform of a state; null unless every character comes back strictly."""
    if state not in STATES[1:-1]:
        return None
    written, read = state.split(">")
    try:
        if written == "utf-8 twice":
            return _write(_write(text, read).decode("utf-8"), read).decode("utf-8")
        return _write(text, read).decode(written)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


_WIDE = {"gb18030", "big5"}
_NO_TEXT = re.compile("[�\x80-\x9f\ue000-\uf8ff]")  # nobody wrote these


@lru_cache(maxsize=100_000)
def _bytes_of(c: str, encoding: str) -> bytes | None:
    try:
        return _write(c, encoding)
    except UnicodeEncodeError:
        return None


def _width(data: bytes, at: int, written: str) -> int:
    """Bytes of the character that begins at ``at``; 0 if none does, one more than there are if that can't be told yet."""
    b = data[at]
    if b < 0x80 or written not in ("utf-8", *_WIDE):
        return 1
    if written == "utf-8":
        return 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
    if b in (0x80, 0xFF):
        return 0
    if written == "gb18030" and at + 1 < len(data) and 0x30 <= data[at + 1] <= 0x39:
        return 4
    return 2


def units(text: str, state: str) -> list[tuple[int, str] | None]:
    """Per place of ``text`` the shortest stretch from there that the state's inverse turns into whole characters: its end and what it turns into."""
    written, read = state.split(">")
    out: list[tuple[int, str] | None] = [None] * len(text)
    if written == "utf-8 twice":
        for i, c in enumerate(text):
            if c > "\x7f":
                for j in range(i + 1, min(len(text), i + 16) + 1):
                    if (back := restore(text[i:j], state)) is not None:
                        out[i] = j, back
                        break
        return out
    own = [_bytes_of(c, read) for c in text]
    for i, c in enumerate(text):
        if c <= "\x7f" or own[i] is None:
            continue
        data, at, j = own[i], 0, i + 1
        while at < len(data) and j - i <= 8:
            width = _width(data, at, written)
            if not width:
                break
            if at + width <= len(data):
                at += width
            elif j < len(text) and own[j] is not None:
                data += own[j]
                j += 1
            else:
                break
        if at == len(data):
            try:
                out[i] = j, data.decode(written)
            except UnicodeDecodeError:
                pass
    return out


def _inside(n: int, spans: list[tuple[int, int, int]]) -> bytearray:
    """Which places of a line of ``n`` characters lie in spans."""
    inside = bytearray(n + 1)
    for a, b, _ in spans:
        b = min(b, n)
        inside[a:b] = b"\1" * (b - a)
    return inside


def _fold(code: int) -> int:
    return 97 if 97 <= code <= 122 else 65 if 65 <= code <= 90 else 48 if 48 <= code <= 57 else code


def _codes(text: str) -> np.ndarray:
    """Code points, ASCII letters and digits folded to one letter, capital or digit."""
    return _folded(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))


def _folded(codes: np.ndarray) -> np.ndarray:
    """``codes`` are unsigned: what is below a range is far beyond it once the range's first is taken off."""
    for first, many in ((97, 26), (65, 26), (48, 10)):
        codes = np.where(codes - np.uint32(first) < many, np.uint32(first), codes)
    return codes


def _bigram(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Only the low 24 bits of the sum count, so that it may run over."""
    return ((before.astype(np.uint32, copy=False) * np.uint32(0x9E3779B1) + now.astype(np.uint32, copy=False) * np.uint32(0x85EBCA6B)) >> 7) & (TABLE - 1)


def _single(now: np.ndarray) -> np.ndarray:
    return ((now.astype(np.uint32, copy=False) * np.uint32(0x9E3779B1)) >> 5) & (TABLE - 1)


def _class(code: int) -> int:
    if code < 0x80:
        return 0
    if code < 0x3400:
        return min(code >> 7, 47)
    if code < 0xA000:
        return 48 + ((code - 0x3400) >> 12)
    return 58 if code < 0xE000 else 59 if code < 0xF900 else 60 if code < 0xFF00 else 61


_CLASSES = np.array([_class(i << 7) for i in range(0x110000 >> 7)], dtype=np.int64)


def _block(codes: np.ndarray) -> np.ndarray:
    """Coarse alphabet of a character: one of 64 classes."""
    blocks = _CLASSES[codes >> 7]
    blocks[codes == 0xFFFD] = 62
    return blocks


BLOCK_SIZE = np.array([20] + [128] * 47 + [4096] * 10 + [8192, 6400, 1536, 240, 1, 1], dtype=np.float64)


#: Places of a state's counts: bigrams, single characters, blocks.
PLACES = 2 * TABLE + 64 * 64


def _places(before: np.ndarray, now: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """How often each bigram, single character and pair of blocks occurs, over the positions beside a character outside ASCII; each ``times``, if given."""
    scored = (before >= 0x80) | (now >= 0x80)
    before, now = before[scored], now[scored]
    n = None if times is None else times[scored].astype(np.float64)  # sums of whole numbers below 2 ** 53 are exact
    parts = [np.bincount(_bigram(before, now), n, TABLE), np.bincount(_single(before), n, TABLE), np.bincount(_block(before) * 64 + _block(now), n, 64 * 64)]
    return np.concatenate(parts).astype(np.int64)


#: How far sums of float32 logs, taken in another order, may differ.
SLACK = 0.05


def _spans(gains: np.ndarray, starts: np.ndarray, lengths: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Of each asked line the most that the positions of one span gain together."""
    lengths = lengths[asked]
    if not len(lengths):
        return np.zeros(0)
    own = np.repeat(starts[asked] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    sums = np.cumsum(gains[own].astype(np.float64))
    first = np.cumsum(lengths) - lengths
    line = np.repeat(np.arange(len(lengths)), lengths)
    before = np.r_[0.0, sums[:-1]]
    apart = line * (np.ptp(np.r_[0.0, sums]) + 1.0)  # so that what precedes a line is never its least
    least = np.minimum.accumulate(before - apart) + apart
    return np.maximum.reduceat(sums - least, first)


class Model:
    """Log probabilities of the states' emissions."""

    def __init__(self, lines: list[str]):
        self.bigrams = np.zeros((len(STATES), TABLE), dtype=np.float32)
        self.singles = np.zeros((len(STATES), TABLE), dtype=np.float32)
        self.blocks = np.zeros((len(STATES), 64 * 64), dtype=np.float32)
        whole = "\n".join(lines)
        outside = [x for x in lines if not x.isascii()]
        for k, state in enumerate(STATES):
            if state == "clean":
                text = whole
            elif state == "lost":
                changed = [garble(x, p) for p in (("cp1252", "utf-8"), ("utf-8", "ascii"), ("gb18030", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8")) for x in outside]
                text = "\n".join(x for x in changed if x and "�" in x)
                twice = [garble(x, ("utf-8", "gb18030")) for x in changed if x and "�" in x]  # U+FFFD written and read once more
                text += "\n" + "\n".join(x for x in twice if x)
            else:
                pair = PAIRS[k - 1]
                changed = [(x, garble(x, pair)) for x in outside]
                text = "\n".join(y for x, y in changed if y and y != x)
            self._count(k, text)
        self._prepare()
        self._logs: dict[int, float] = {}
        dirty = {i for i, spans in enumerate(self.label(outside)) if self.verdict(outside[i], spans)}
        self._count(0, "\n".join([x for x in lines if x.isascii()] + [x for i, x in enumerate(outside) if i not in dirty]))
        self._logs.clear()

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Model:
        """The model of :func:`_places` counted per state; the clean state on all lines."""
        self = cls.__new__(cls)
        self.bigrams = np.zeros((len(STATES), TABLE), dtype=np.float32)
        self.singles = np.zeros((len(STATES), TABLE), dtype=np.float32)
        self.blocks = np.zeros((len(STATES), 64 * 64), dtype=np.float32)
        for k in range(len(STATES)):
            self._set(k, counts[k])
        self._prepare()
        self._logs = {}
        return self

    def __getstate__(self) -> dict:
        """Without the places that nothing was counted at, which are most."""
        state = {k: v for k, v in self.__dict__.items() if k not in ("_of", "_feeds", "_logs", "_turned")}
        for name in ("bigrams", "singles"):
            at = np.flatnonzero(state[name])
            state[name] = state[name].shape, at.astype(np.int32), state[name].ravel()[at]
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._logs, self._turned = {}, None
        for name in ("bigrams", "singles"):
            shape, at, values = state[name]
            table = np.zeros(shape, dtype=np.float32)
            table.ravel()[at] = values
            setattr(self, name, table)

    def _count(self, k: int, text: str) -> None:
        """Probabilities of (before, now) pairs of a state: joint, so that both sides of a boundary count."""
        codes = _codes("\n" + text + "\n")
        self._set(k, _places(codes[:-1], codes[1:]))

    def _set(self, k: int, counts: np.ndarray) -> None:
        self._turned = None
        bigrams, singles, blocks = counts[:TABLE], counts[TABLE : 2 * TABLE], counts[2 * TABLE :]
        total = max(int(singles.sum()), 1)
        self.bigrams[k] = bigrams / total
        self.singles[k] = singles / total
        self.blocks[k] = (blocks + 1e-3) / (total + 1e-3 * 4096)

    def _prepare(self) -> None:
        """A last row bounds every state but the clean one from above."""
        self.bigrams, self.singles, self.blocks = (np.vstack([x, x[1:].max(axis=0)]) for x in (self.bigrams, self.singles, self.blocks))

    def _probability(self, k: int | slice, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        return self._at(k, self._where(before, now))

    @staticmethod
    def _where(before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the probabilities of positions stand in the tables, and the sizes of their blocks."""
        first, second = _block(before), _block(now)
        return _bigram(before, now), _single(before), _single(now), first * 64 + second, (BLOCK_SIZE[first] * BLOCK_SIZE[second]).astype(np.float32)

    def _at(self, k: int | slice, where: tuple[np.ndarray, ...]) -> np.ndarray:
        b, s1, s2, g, size = where
        return WEIGHTS[0] * self.bigrams[k, b] + WEIGHTS[1] * self.singles[k, s1] * self.singles[k, s2] + WEIGHTS[2] * self.blocks[k, g] / size + 1e-14

    def _all(self, where: tuple[np.ndarray, ...]) -> np.ndarray:
        """:meth:`_at` of all states, a row for each position; what stands of a place in the tables lies together."""
        if self._turned is None:
            self._turned = tuple(np.ascontiguousarray(x[: len(STATES)].T) for x in (self.bigrams, self.singles, self.blocks))
        bigrams, singles, blocks = self._turned
        b, s1, s2, g, size = where
        return WEIGHTS[0] * bigrams[b] + WEIGHTS[1] * singles[s1] * singles[s2] + WEIGHTS[2] * blocks[g] / size[:, None] + 1e-14

    def emissions(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Log probability per position and state."""
        return np.log(self._all(self._where(before, now)))

    def label(self, lines: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per line the spans (from, to, state) that aren't clean."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in lines]
        asked = [i for i, x in enumerate(lines) if not x.isascii()]
        if not asked:
            return found
        codes = np.frombuffer(("\n" + "\n".join(lines[i] for i in asked) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        beyond = codes >= 0x80
        at = np.flatnonzero(beyond[:-1] | beyond[1:])
        before, now = _folded(codes[at]), _folded(codes[at + 1])
        line_of = np.searchsorted(np.flatnonzero(codes == 10), at, side="right") - 1  # the line that `before` stands in, or that its line feed opens
        starts = np.flatnonzero(np.r_[True, line_of[1:] != line_of[:-1]])
        lengths = np.diff(np.r_[starts, len(at)])
        # a line stays clean if not even the best of all states at each position of a span could make up for the first change of state
        where = self._where(before, now)
        clean, most = self._at(0, where), self._at(-1, where)
        more = np.log(most) - np.log(clean)
        possible = np.add.reduceat(np.maximum(more, 0.0), starts) > -np.log(DIRTY)
        enough = -np.log(DIRTY / (len(STATES) - 1))
        possible[possible] = _spans(more, starts, lengths, possible) > enough - SLACK
        if not possible.any():
            return found
        picked = np.flatnonzero(np.repeat(possible, lengths))
        scores = np.log(self._all(tuple(x[picked] for x in where)))
        ends = np.cumsum(lengths[possible])
        worth: list[tuple[int, int, np.ndarray]] = []
        for s, n, end in zip(starts[possible], lengths[possible], ends):
            own = scores[end - n : end]
            sums = np.vstack([np.zeros(len(STATES), dtype=np.float32), np.cumsum(own - own[:, :1], axis=0)])
            if (sums - np.minimum.accumulate(sums, axis=0)).max() > enough:  # else no span in one state pays for entering it
                worth.append((s, n, own))
        for (s, n, _), path in zip(worth, self._paths([own for _, _, own in worth])):
            if not path.any():
                continue
            line = int(line_of[s])
            spans: list[tuple[int, int, int]] = []
            offset = self._offset(codes, line)
            k = 0
            while k < n:
                state = int(path[k])
                j = k
                while j + 1 < n and path[j + 1] == state:
                    j += 1
                if state:
                    spans.append((max(int(at[s + k]) - offset, 0), max(int(at[s + j]) - offset + 1, 0), state))
                k = j + 1
            found[asked[line]] = spans
        return found

    def clean_score(self, text: str) -> float:
        """Log probability as clean text, over the positions beside a character outside ASCII; plain text has 0."""
        codes = _codes("\n" + text + "\n")
        before, now = codes[:-1], codes[1:]
        at = (before >= 0x80) | (now >= 0x80)
        return float(np.log(self._probability(0, before[at], now[at])).sum()) if at.any() else 0.0

    def odd(self, lines: list[str]) -> list[bool]:
        """Whether a line's positions are so unlikely as clean text that it is worth a closer look."""
        out = [False] * len(lines)
        if not lines:
            return out
        codes = np.frombuffer(("\n" + "\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        beyond = codes >= 0x80
        at = np.flatnonzero(beyond[:-1] | beyond[1:])
        if not len(at):
            return out
        line_of = np.searchsorted(np.flatnonzero(codes == 10), at, side="right") - 1
        logs = np.log(self._probability(0, _folded(codes[at]), _folded(codes[at + 1])))
        starts = np.flatnonzero(np.r_[True, line_of[1:] != line_of[:-1]])
        means = np.add.reduceat(logs, starts) / np.diff(np.r_[starts, len(at)])
        for k in np.flatnonzero(means <= USUAL):
            out[int(line_of[starts[k]])] = True
        return out

    def mean(self, line: str) -> float:
        codes = _codes("\n" + line + "\n")
        n = int(((codes[:-1] >= 0x80) | (codes[1:] >= 0x80)).sum())
        return self.clean_score(line) / n if n else 0.0

    def mend(self, line: str, spans: list[tuple[int, int, int]] | None = None) -> str | None:
        """The original of a garbled line, as far as it can be told; an empty string if not at all, null for a clean line. ``spans`` are its labels, if they are known."""
        spans = self.label([line])[0] if spans is None else spans
        found = self.verdict(line, spans)
        if found and found[1]:
            return found[1]
        if found is None and "�" not in line:
            return None
        best, rough, least = self.mean(line) + 1.0, "", len(line) / 6  # letters that must be left
        tried = {line}
        for state in dict.fromkeys([*(STATES[s] for _, _, s in spans), *STATES[1:-1]]):
            if state != "lost" and not state.startswith("utf-8 twice"):
                written, read = state.split(">")
                text = line.replace("�", "").encode(read, "ignore").decode(written, "ignore")
                if text in tried:
                    continue
                tried.add(text)
                if sum(map(str.isalpha, text)) >= least and len(text) >= len(line) / 4 and self.mean(text) > best:
                    best, rough = self.mean(text), text
        return rough

    def _log(self, before: int, now: int) -> float:
        """Log probability of one position as clean text; 0 beside no character outside ASCII. Code points are folded."""
        if before < 0x80 and now < 0x80:
            return 0.0
        key = before << 21 | now
        found = self._logs.get(key)
        if found is None:
            a, b = _CLASSES[before >> 7] if before != 0xFFFD else 62, _CLASSES[now >> 7] if now != 0xFFFD else 62
            pair = self.bigrams[0, (before * 0x9E3779B1 + now * 0x85EBCA6B) >> 7 & TABLE - 1]
            single = self.singles[0, before * 0x9E3779B1 >> 5 & TABLE - 1] * self.singles[0, now * 0x9E3779B1 >> 5 & TABLE - 1]
            found = math.log(WEIGHTS[0] * float(pair) + WEIGHTS[1] * float(single) + WEIGHTS[2] * float(self.blocks[0, a * 64 + b]) / (BLOCK_SIZE[a] * BLOCK_SIZE[b]) + 1e-14)
            if len(self._logs) > 1_000_000:
                self._logs.clear()
            self._logs[key] = found
        return found

    def unmix(self, line: str, states: list[str], spans: list[tuple[int, int, int]]) -> tuple[float, list[tuple[int, int, str | None, str]]]:
        """What ``line`` gains as clean text, and its pieces (from, to, state or null where kept, text) on the best path."""
        tables = []
        for state in states:
            own: list[tuple | None] = []
            for u in units(line, state):
                if u is not None:
                    folded = [_fold(ord(c)) for c in u[1]]
                    u = (*u, folded[0], folded[-1], sum(map(self._log, folded, folded[1:])))
                own.append(u)
            tables.append(own)
        n, modes = len(line), range(len(states) + 1)
        inside, near = _inside(n, spans), _inside(n, [(*self._words(line, s), 0) for s in spans])
        letters = [c > "\x7f" and c.isalpha() for c in line]
        # an entry: score, last code, mode, entry before, (from, to, text)
        rows: list[list[tuple | None]] = [[None] * len(modes) for _ in range(n + 1)]
        rows[0][0] = (0.0, 10, 0, None, None)
        verbatim, last = 0.0, 10
        log = self._log
        for i, c in enumerate(line):
            code = _fold(ord(c))
            verbatim += log(last, code)
            last = code
            entries = [e for e in rows[i] if e is not None]
            rows[i] = []  # type: ignore[assignment]
            if code < 0x80:
                after = rows[i + 1]
                for e in entries:
                    score = e[0] + log(e[1], code)
                    if after[e[2]] is None or score > after[e[2]][0]:
                        after[e[2]] = (score, code, e[2], e, (i, i + 1, c))
                continue
            change = CHANGE + (WITHIN if i and letters[i] and letters[i - 1] else 0.0)
            enter = change + (0.0 if near[i] else APART)
            for e in entries:
                score = e[0] + log(e[1], code)
                if e[2]:
                    score -= change
                if inside[i]:
                    score -= KEEP
                if rows[i + 1][0] is None or score > rows[i + 1][0][0]:
                    rows[i + 1][0] = (score, code, 0, e, (i, i + 1, c))
            for k, table in enumerate(tables, 1):
                if (u := table[i]) is None:
                    continue
                end, text, first, final, inner = u
                for e in entries:
                    score = e[0] + log(e[1], first) + inner - (0.0 if e[2] == k else change if e[2] else enter)
                    if rows[end][k] is None or score > rows[end][k][0]:
                        rows[end][k] = (score, final, k, e, (i, end, text))
        verbatim += log(last, 10)
        best = max((e for e in rows[n] if e is not None), key=lambda e: e[0] + log(e[1], 10))
        gain = best[0] + log(best[1], 10) - verbatim
        pieces = []
        while best[4] is not None:
            a, b, text = best[4]
            pieces.append((a, b, states[best[2] - 1] if best[2] and text != line[a:b] else None, text))
            best = best[3]
        return gain, pieces[::-1]

    def verdict(self, line: str, spans: list[tuple[int, int, int]]) -> tuple[str, str | None] | None:
        """(state, original line or null) of a labelled line; null if it is clean after all."""
        if not spans:
            return None
        lost = any("�" in line[a:b] or "锟斤拷" in line[max(a - 2, 0) : b + 2] for a, b, _ in spans)
        if not lost and (not any(c.isalpha() for c in line) or line.lower() != line == line.upper() and self.mean(line.lower()) > USUAL):
            return None  # marks alone, or capitals, which are rare, not garbled
        longest_first = sorted(spans, key=lambda s: s[0] - s[1])
        states = list(dict.fromkeys(STATES[s] for _, _, s in longest_first if STATES[s] != "lost"))
        if len(states) == 1 and not lost and "�" not in line and self._covers(line, spans):  # one state's span is the whole line, so its inverse is the line's
            back = restore(line, states[0])
            if back is not None and back != line and not _NO_TEXT.search(back) and self._usual(back) and self.clean_score(back) >= self.clean_score(line) + MARGIN:
                return states[0], back
        gain, pieces = self.unmix(line, states, spans) if states else (0.0, [])
        if not lost and (gain < MARGIN or self._left(line, spans, pieces)):  # the label may name a pair that differs in few characters from the right one
            wider = [x for x in dict.fromkeys(self._likeliest(line[a:b]) for a, b in [(0, len(line)), *(self._words(line, s) for s in spans)]) if x and x not in states]
            if wider:
                again = self.unmix(line, [*states, *wider], spans)
                if again[0] > gain + CHANGE:
                    gain, pieces = again
        changed = [p for p in pieces if p[2]]
        if gain < MARGIN or not changed:
            return ("lost", None) if lost else None
        size: dict[str, int] = {}
        for a, b, state, _ in changed:
            size[state] = size.get(state, 0) + b - a
        back = "".join(p[3] for p in pieces)
        whole = "�" not in line and not any(_NO_TEXT.search(p[3]) for p in changed) and not self._left(line, spans, pieces)
        return ("lost" if lost else max(size, key=lambda k: size[k])), back if whole else None

    def _usual(self, text: str) -> bool:
        """Whether no character outside ASCII is unlikely where it stands."""
        codes = _codes("\n" + text + "\n")
        logs = np.log(self._probability(0, codes[:-1], codes[1:]))
        return not ((logs[:-1] + logs[1:] <= 2 * USUAL) & (codes[1:-1] >= 0x80)).any()

    @staticmethod
    def _covers(line: str, spans: list[tuple[int, int, int]]) -> bool:
        """Whether spans hold all characters outside ASCII."""
        left = line
        for a, b, _ in sorted(spans, reverse=True):
            left = left[:a] + left[b:]
        return left.isascii()

    def _likeliest(self, text: str) -> str | None:
        """The pair whose inverse turns all of ``text`` into the likeliest clean text, if that gains enough."""
        best, found = self.clean_score(text) + MARGIN, None
        for state in STATES[1:-1]:
            back = restore(text, state)
            if back is not None and back != text and "�" not in back and (score := self.clean_score(back)) > best:
                best, found = score, state
        return found

    @staticmethod
    def _words(line: str, span: tuple[int, int, int]) -> tuple[int, int]:
        """A span with the words that it begins and ends in."""
        a, b, _ = span
        while a > 0 and not line[a - 1].isspace():
            a -= 1
        while b < len(line) and not line[b].isspace():
            b += 1
        return a, b

    def _left(self, line: str, spans: list[tuple[int, int, int]], pieces: list[tuple[int, int, str | None, str]]) -> bool:
        """Whether unlikely characters of a labelled span are still there."""
        codes = [10]
        asked = []
        inside = _inside(len(line), spans)
        for a, b, state, text in pieces or [(i, i + 1, None, c) for i, c in enumerate(line)]:
            if state is None and inside[a] and text > "\x7f":
                asked.append(len(codes))
            codes += [_fold(ord(c)) for c in text]
        codes.append(10)
        return any(self._log(codes[k - 1], codes[k]) + self._log(codes[k], codes[k + 1]) <= 2 * USUAL for k in asked)

    def _offset(self, codes: np.ndarray, line: int) -> int:
        if getattr(self, "_of", None) is not codes:
            self._of, self._feeds = codes, np.flatnonzero(codes == 10)
        return int(self._feeds[line]) + 1

    @staticmethod
    def _paths(scores: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest path of each line through all states. From one pair to another it is as far as by way of clean text.

        Lines of like length go side by side, the shorter ones followed by positions that tell nothing.
        """
        paths: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        stay, back, out = np.log1p(-LEAVE), np.log(LEAVE), np.log(LEAVE / (len(STATES) - 1))
        while order:
            longest = len(scores[order[-1]])
            together = [i for i in order[-max(1, PATH_POSITIONS // longest) :] if len(scores[i]) * 2 >= longest]
            order = order[: -len(together)]
            rows = np.zeros((longest, len(together), len(STATES)))
            for j, i in enumerate(together):
                rows[: len(scores[i]), j] = scores[i]
            value = rows[0] + np.log(DIRTY / (len(STATES) - 1))
            value[:, 0] = rows[0, :, 0] + np.log1p(-DIRTY)
            stays = np.empty(rows.shape, dtype=bool)
            to_clean, to_dirty = np.zeros((longest, len(together)), dtype=np.int64), np.zeros((longest, len(together)), dtype=np.int64)
            each = np.arange(len(together))
            for t in range(1, longest):
                top = value[:, 1:].argmax(axis=1) + 1
                clean, kept = value[each, top] + back, value[:, 0]
                to_clean[t], to_dirty[t] = top, np.where(kept >= clean, 0, top)
                jump = (np.maximum(kept, clean) + out)[:, None]
                stayed = value + stay
                np.greater_equal(stayed, jump, out=stays[t])
                stays[t, :, 0] = stayed[:, 0] >= clean
                first = np.maximum(stayed[:, 0], clean)
                np.maximum(stayed, jump, out=value)
                value[:, 0] = first
                value += rows[t]
            path = np.empty((longest, len(together)), dtype=np.int64)
            path[-1] = value.argmax(axis=1)
            for t in range(longest - 1, 0, -1):
                k = path[t]
                path[t - 1] = np.where(stays[t, each, k], k, np.where(k > 0, to_dirty[t], to_clean[t]))
            for j, i in enumerate(together):
                paths[i] = path[: len(scores[i]), j]
        return paths


def sample(df: DataFrame, text: str, pages: int = SAMPLE_PAGES, characters: int = SAMPLE_CHARACTERS, longest: int = SAMPLE_LONGEST, source: str | None = None) -> list:
    """At most ``pages`` distinct texts, picked by hash, until they hold ``characters`` characters; with ``source``, pairs of a text and that column.

    Texts of more than ``longest`` characters aren't drawn, so what reaches the driver is bounded whatever the data. A text that
    stands on many pages is drawn once. ``df`` may be part of the corpus, such as some of its files.
    """
    rows = df.select(F.col(text).alias("t"), (F.col(source) if source else F.lit(None).cast("string")).alias("s")).where((F.length("t") > 0) & (F.length("t") <= longest)).withColumn("h", F.xxhash64("t"))
    share = min(1.0, 2 * pages / max(df.count(), 1))  # twice as many as are wanted pass the hash, so that sorting them is bounded, too
    while True:
        picked = rows.where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000) + 1).groupBy("h").agg(F.min(F.struct("t", "s")).alias("r")).orderBy("h").limit(pages).select("r.*")
        drawn: list = []
        left = characters
        for row in picked.toLocalIterator():
            if left <= 0:
                break
            drawn.append((row.t, row.s) if source else row.t)
            left -= len(row.t)
        if left <= 0 or len(drawn) >= pages or share >= 1.0:
            return drawn
        share = min(1.0, 8 * share)  # few distinct texts among many copies


#: Wrong readings that lose characters.
LOSSES = [("cp1252", "utf-8"), ("utf-8", "ascii"), ("gb18030", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8")]
#: Pairs whose reader takes several bytes together, so that what a character turns into depends on its neighbours; blanks separate them.
TOGETHER = [k for k, (_, read) in enumerate(PAIRS) if read in ("gb18030", "big5", "shift_jis")]
#: Bigrams and words of a task that are held before they are counted.
HELD = 300_000
#: At a line's very end a reader of several bytes takes what follows a digit for cut off, so such words are read alone.
_DIGIT = re.compile(b"[0-9]")
COUNTS = T.StructType([T.StructField("lines", T.LongType()), T.StructField("place", T.LongType()), T.StructField("n", T.LongType())])


def _bits(c: str) -> tuple[int, int]:
    """Bit k if pair k changes a character, bit 32 + k if it can't be written in it; bit k of the second number if a loss's encoding can't write it."""
    pairs = losses = 0
    for k, pair in enumerate(PAIRS):
        other = garble(c, pair)
        pairs |= 1 << 32 + k if other is None else (other != c) << k
    for k, (written, _) in enumerate(LOSSES):
        losses |= (_bytes_of(c, written) is None) << k
    return pairs, losses


@lru_cache(maxsize=1)
def _bit_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_bits` of all characters, and which of them are known so far."""
    known = np.zeros(0x110000, dtype=bool)
    known[:0x80] = True
    return known, np.zeros(0x110000, dtype=np.int64), np.zeros(0x110000, dtype=np.uint8)


def _loses(lines: list[str], barred: np.ndarray) -> np.ndarray:
    """Per line bit k if loss k loses characters of it; ``barred`` has bit k where the loss's encoding can't write a line."""
    out = np.zeros(len(lines), dtype=np.int64)
    for k, (written, read) in enumerate(LOSSES):
        own = np.flatnonzero(barred >> k & 1 == 0)
        if len(own):  # no line feed is ever part of a character
            data = _write("\n".join([lines[i] for i in own]), written)
            lost = [not x.isascii() if read == "ascii" else "�" in x for x in (data.split(b"\n") if read == "ascii" else data.decode(read, "replace").split("\n"))]
            out[own] |= np.array(lost, dtype=np.int64) << k
    return out


def _weighted(lines: list[str], times: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes (before, now) of all places of lines, and how often each counts."""
    codes = _codes("\n" + "\n".join(lines) + "\n")
    return codes[:-1], codes[1:], np.array(times, dtype=np.int64)[np.cumsum(codes == 10)[:-1] - 1]


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


class Counter:
    """Counts of a task's lines: bigrams by the pairs that change their lines, and what words turn into where characters are read together."""

    def __init__(self) -> None:
        self.words: dict[tuple[int, str], int] = {}
        self.lost = np.zeros((len(STATES), PLACES), dtype=np.int64)
        self.groups: dict[int, int] = {}
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, lines: list[str], times: list[int]) -> None:
        """Counts lines that aren't plain ASCII, each so many times."""
        if not lines:
            return
        text, each = "\n" + "\n".join(lines) + "\n", np.array(times, dtype=np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        feeds, beyond = np.flatnonzero(codes == 10), codes >= 0x80
        known, pairs, losses = _bit_tables()
        for c in np.unique(codes[~known[codes]]):
            known[c], (pairs[c], losses[c]) = True, _bits(chr(c))
        bits = np.bitwise_or.reduceat(pairs[codes], feeds[:-1])
        changed = bits & ~(bits >> 32) & (1 << len(PAIRS)) - 1
        asked = changed & sum(1 << k for k in TOGETHER) | _loses(lines, np.bitwise_or.reduceat(losses[codes], feeds[:-1])) << 32

        blanks = np.flatnonzero((codes == 32) | (codes == 10))
        odd = np.flatnonzero(np.add.reduceat(beyond, blanks[:-1], dtype=np.int64))
        a, b = blanks[odd], blanks[odd + 1]
        line = np.searchsorted(feeds, a, side="right") - 1
        words = self.words
        for i, j, q, n, last in zip(a.tolist(), (b + 1).tolist(), asked[line].tolist(), each[line].tolist(), (codes[b] == 10).tolist()):
            w = text[i:j]
            if last and _DIGIT.search(w[1:-1][-3:].encode("gb18030", "replace")):
                w = w[:-1]
            words[q, w] = words.get((q, w), 0) + n

        at = np.flatnonzero(beyond[:-1] | beyond[1:])
        line = np.searchsorted(feeds, at, side="right") - 1
        found, of = np.unique(changed, return_inverse=True)
        group = np.array([self.groups.setdefault(int(x), len(self.groups)) for x in found])[of][line]
        before, now = _folded(codes[at]), _folded(codes[at + 1])
        self.keys.append(_added(group << 42 | before.astype(np.int64) << 21 | now.astype(np.int64), each[line]))
        if sum(len(k) for k, _ in self.keys) > 4 * HELD:
            self._merge()
        if len(words) > HELD:
            self._read()

    def _merge(self) -> None:
        if self.keys:
            self.keys = [_added(np.concatenate([k for k, _ in self.keys]), np.concatenate([n for _, n in self.keys]))]

    def _read(self) -> None:
        """Puts the words that are held through what reads characters together."""
        of: dict[int, tuple[list[str], list[int]]] = {}
        for (asked, w), n in self.words.items():
            some = of.setdefault(asked, ([], []))
            some[0].append(w)
            some[1].append(n)
        self.words.clear()
        for k in [*TOGETHER, *range(32, 32 + len(LOSSES))]:
            state = k + 1 if k < 32 else len(STATES) - 1
            own = [x for asked, x in of.items() if asked >> k & 1]
            words, times = [w for x in own for w in x[0]], np.array([n for x in own for n in x[1]], dtype=np.int64)
            ended = np.array([w[-1] in " \n" for w in words], dtype=bool)
            alone = [words[i] for i in np.flatnonzero(~ended)]
            whole = "".join([words[i] for i in np.flatnonzero(ended)]) + "\n\n\n"  # no reader makes or takes a blank, so each word keeps its two
            pair = PAIRS[k] if k < 32 else LOSSES[k - 32]
            read = [garble(x, pair) for x in [whole, *alone]]
            for one in [read, [garble(x, ("utf-8", "gb18030")) for x in read]] if k >= 32 else [read]:  # U+FFFD written and read once more
                codes = _codes(one[0])
                nth = np.cumsum((codes == 32) | (codes == 10)) - 1 >> 1
                self.lost[state] += _places(codes[:-1], codes[1:], np.r_[times[ended], 0, 0][nth[:-1]])
                if alone:
                    codes = _codes("\n".join(one[1:]) + "\n")
                    self.lost[state] += _places(codes[:-1], codes[1:], np.repeat(times[~ended], [len(x) + 1 for x in one[1:]])[:-1])

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """What lines have in common, the places, how often each: negative for a state's places, else the pairs that change them and their bigrams."""
        self._read()
        for k in range(len(STATES)):
            at = np.flatnonzero(self.lost[k])
            if len(at):
                yield -1 - k, at, self.lost[k][at]
        self._merge()
        for keys, n in self.keys:
            for changed, group in self.groups.items():
                a, b = np.searchsorted(keys, [group << 42, group + 1 << 42])
                yield changed, keys[a:b] & (1 << 42) - 1, n[a:b]


class Expander:
    """Counts of the states from counts of bigrams."""

    def __init__(self) -> None:
        self.counts = np.zeros((len(STATES), PLACES), dtype=np.int64)
        self.turned: dict[tuple[int, int], tuple[int, int, list[tuple[int, int]]]] = {}

    def _turn(self, k: int, code: int) -> tuple[int, int, list[tuple[int, int]]]:
        """First and last code that a character turns into by a pair, and the bigrams between."""
        found = self.turned.get((k, code))
        if found is None:
            codes = [_fold(ord(c)) for c in garble(chr(code), PAIRS[k])]
            found = self.turned[k, code] = codes[0], codes[-1], list(zip(codes, codes[1:]))
        return found

    def add(self, changed: int, keys: np.ndarray, n: np.ndarray) -> None:
        if changed < 0:
            self.counts[-1 - changed] += np.bincount(keys, n, PLACES).astype(np.int64)
            return
        before, now = keys >> 21, keys & (1 << 21) - 1
        self.counts[0] += _places(before, now, n)
        chars, at = np.unique(np.concatenate([before, now]), return_inverse=True)
        held = np.bincount(at[len(before) :], n, len(chars))
        for k in range(len(PAIRS)):
            if changed >> k & 1 and k not in TOGETHER:
                turned = [self._turn(k, int(c)) for c in chars]
                first, last = np.array([t[0] for t in turned]), np.array([t[1] for t in turned])
                inner = [(a, b, m) for t, m in zip(turned, held) for a, b in t[2]]
                a, b, m = (np.array([x[i] for x in inner], dtype=np.int64) for i in range(3))
                self.counts[k + 1] += _places(np.concatenate([last[at[: len(before)]], a]), np.concatenate([first[at[len(before) :]], b]), np.concatenate([n, m]))


def _batches(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lines, place, n in parts:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), lines, dtype=np.int64)), pa.array(place.astype(np.int64)), pa.array(n.astype(np.int64))], ["lines", "place", "n"])


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in batches:
        counter.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    yield from _batches(list(counter.rows()))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expander = Expander()
    for batch in batches:
        lines, place, n = (np.asarray(c) for c in batch.columns)
        for changed in np.unique(lines):
            own = lines == changed
            expander.add(int(changed), place[own], n[own])
    yield from _batches([(k, at, expander.counts[k][at]) for k in range(len(STATES)) if len(at := np.flatnonzero(expander.counts[k]))])


def _summed(rows: DataFrame) -> np.ndarray:
    """Counts by state and place; at most one row for each reaches the driver."""
    out = np.zeros((len(STATES), PLACES), dtype=np.int64)
    found = rows.groupBy("lines", "place").agg(F.sum("n").alias("n")).toArrow()
    lines, place, n = (found.column(i).to_numpy() for i in range(3))
    out[lines, place] = n
    return out


def odd_lines(df: DataFrame, text: str, distinct: bool = False) -> DataFrame:
    """(``line``, ``n``): the lines that hold characters outside ASCII and how often they stand in distinct texts; copies of a text count once.
    ``distinct`` tells that there are none."""
    beyond = "[^\\x00-\\x7f]"
    own = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(beyond))
    texts = df.where(F.col(text).rlike(beyond)).select(F.xxhash64(text).alias("h"), F.array_join(own, "\n").alias("t"))
    texts = texts if distinct else texts.distinct()
    return texts.select(F.explode(F.split("t", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def fit(df: DataFrame, text: str, distinct: bool = False) -> Model:
    """The model of a corpus, counted over all its distinct texts; equal to the :class:`Model` of their lines, however many they are.
    ``distinct`` tells that ``df`` holds each text once."""
    lines = stored(odd_lines(df, text, distinct))
    counts = _summed(lines.mapInArrow(_count_lines, COUNTS).groupBy("lines", "place").agg(F.sum("n").alias("n")).mapInArrow(_expand, COUNTS))
    model = Model.of_counts(counts)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def garbled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = shared.value, np.zeros(PLACES, dtype=np.int64)
        for batch in batches:
            values, times, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(values):
                size, start = 0, at
                while at < len(values) and size < BATCH_CHARACTERS:
                    size += len(values[at])
                    at += 1
                some = values[start:at]
                dirty = [i for i, (x, spans) in enumerate(zip(some, own.label(some))) if own.verdict(x, spans)]
                if dirty:
                    found += _places(*_weighted([some[i] for i in dirty], [times[start + i] for i in dirty]))
        at = np.flatnonzero(found)
        yield from _batches([(0, at, found[at])])

    model._set(0, counts[0] - _summed(lines.mapInArrow(garbled, COUNTS))[0])
    shared.destroy()
    release(lines)
    model._logs.clear()
    return model


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Writes a model, so that several jobs share one fit."""
    spark.createDataFrame([(bytearray(zlib.compress(pickle.dumps(model), 1)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    return pickle.loads(zlib.decompress(bytes(spark.read.parquet(path).first().model)))


LABELS = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("state", T.StringType()), T.StructField("restored", T.StringType())]))


def garbled_lines(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(``key``, ``line_no``, ``state``, ``restored``): the lines of each text that hold garbled characters.

    Lines are counted from 1. ``state`` names the pair of the longest garbled span, ``lost`` where characters are gone;
    ``restored`` is the original line, null where it doesn't come back strictly. Null and empty texts have no such
    lines. Rows of equal key, line and state count once. Whole texts are read.
    """
    broadcast = df.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = broadcast.value
        for batch in batches:
            out: list[list | None] = [None] * len(batch)
            lines, where, size = [], [], 0
            values = list(batch)
            for i, t in enumerate(values):
                if t is not None and not t.isascii():
                    for j, x in enumerate(t.split("\n")):
                        if not x.isascii():
                            lines.append(x)
                            where.append((i, j))
                            size += len(x)
                if lines and (size >= BATCH_CHARACTERS or i == len(values) - 1):
                    for (p, j), x, spans in zip(where, lines, own.label(lines)):
                        if found := own.verdict(x, spans):
                            out[p] = (out[p] or []) + [{"line_no": j + 1, "state": found[0], "restored": found[1]}]
                    lines, where, size = [], [], 0
            yield pd.Series(out)

    found = df.select(F.col(key).alias("_key"), F.explode(F.pandas_udf(label, LABELS)(F.col(text))).alias("_x"))
    return found.select(F.col("_key").alias(key), "_x.line_no", "_x.state", "_x.restored").distinct()
