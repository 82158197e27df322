"""Text measures that need Unicode normalisation, as Arrow functions over whole batches."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words before an author's name that don't belong to it.
AUTHOR_PREFIXES = ("记者", "通讯员", "作者", "执笔", "by")

#: Product of two lengths up to which difflib is the faster of two equal ways to find matching blocks.
SMALL = 4_000_000

_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_BRACKETS = re.compile(r"[（(][^）)]*[）)]")
_PREFIX = re.compile(f"(?:{'|'.join(AUTHOR_PREFIXES)})(?=.)", re.S)


def normal(text: str) -> str:
    """NFKC, case folded, without white space."""
    return "".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold().split())


def trigrams(text: str) -> Counter:
    """Three-character strings with their counts; a shorter text is its own."""
    if len(text) < 3:
        return Counter([text] if text else [])
    return Counter(map("".join, zip(text, text[1:], text[2:])))


def overlap(pred: Counter, gold: Counter) -> tuple[float, float, float]:
    """Precision, recall and F1 of two bags."""
    common = sum(min(n, gold[g]) for g, n in pred.items() if g in gold)
    a, b = pred.total(), gold.total()
    p, r = (common / a if a else 0.0), (common / b if b else 0.0)
    return p, r, (2 * p * r / (p + r) if common else 0.0)


def longest_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in ``a``, start in ``b``, length) of the longest common run, the first in ``a``, then in ``b``.

    A run is named by the names of the two shorter runs that cover it, so names are exact; lengths are doubled, then halved in.
    """
    n, limit = len(a) + len(b), min(len(a), len(b))
    name = lambda keys: np.unique(keys, return_inverse=True)[1].astype(np.int64)
    longer = lambda names, w, k: name(names[: n - k + 1] * n + names[k - w : n - w + 1])
    shared = lambda names, k: np.isin(names[: len(a) - k + 1], names[len(a) : n - k + 1])
    names, w = name(np.concatenate([a, b])), 1
    if not limit or not shared(names, 1).any():
        return 0, 0, 0
    while 2 * w <= limit and shared(wider := longer(names, w, 2 * w), 2 * w).any():
        names, w = wider, 2 * w
    low, high = w, min(2 * w - 1, limit)
    while low < high:
        k = (low + high + 1) // 2
        if shared(longer(names, w, k), k).any():
            low = k
        else:
            high = k - 1
    names = longer(names, w, low)
    i = int(shared(names, low).argmax())
    return i, int((names[len(a) : n - low + 1] == names[i]).argmax()), low


def matched(a: str, b: str, small: int = SMALL) -> int:
    """Characters in the matching blocks of ``difflib.SequenceMatcher`` without junk; texts of any length."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
    total, left = 0, [(0, len(a), 0, len(b))]
    while left:
        i, j, k, m = left.pop()
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= small:
            total += sum(s.size for s in SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_matching_blocks())
            continue
        p, q, size = longest_run(x[i:j], y[k:m])
        if size:
            total += size
            left += [(i, i + p, k, k + q), (i + p + size, j, k + q + size, m)]
    return total


def in_order(a: str, b: str) -> float | None:
    """Share of characters in matching blocks taken in order (Ratcliff and Obershelp); null if both are empty."""
    if not a and not b:
        return None
    return 2 * matched(a, b) / (len(a) + len(b))


def author_key(name: str) -> str:
    """A name without roles in brackets, white space and introducing words."""
    key = "".join(_BRACKETS.sub("", unicodedata.normalize("NFKC", name).casefold()).split())
    while m := _PREFIX.match(key):
        key = key[m.end() :]
    return key


def compare(pred: str, gold: str) -> tuple[float, float, float, float, float | None]:
    """Precision, recall and F1 of trigrams, share of repeated trigrams of ``pred``, F1 of numbers (null if neither has any)."""
    p, g = normal(pred), normal(gold)
    a, b = trigrams(p), trigrams(g)
    n, m = Counter(_NUMBER.findall(p)), Counter(_NUMBER.findall(g))
    total = a.total()
    return *overlap(a, b), ((total - len(a)) / total if total else 0.0), (overlap(n, m)[2] if n or m else None)


_COMPARED = T.StructType([T.StructField(x, T.DoubleType()) for x in ("precision", "recall", "f1", "dup_ratio", "num_f1")])


@F.pandas_udf(T.StringType())
def normal_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normal(t))


@F.pandas_udf(_COMPARED)
def compare_texts(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """:func:`compare` per row; nulls count as empty texts."""
    return pd.DataFrame([compare(p or "", g or "") for p, g in zip(pred, gold)], columns=[f.name for f in _COMPARED], dtype="float64")


@F.pandas_udf(T.DoubleType())
def in_order_f1(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """:func:`in_order` of normal texts. Quadratic in the worst case: meant for titles and short texts."""
    return pd.Series([in_order(normal(p or ""), normal(g or "")) for p, g in zip(pred, gold)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def author_keys(names: pd.Series) -> pd.Series:
    """Distinct non-empty keys of a list of names, in order; null stays null."""
    return names.map(lambda xs: None if xs is None else [k for k in dict.fromkeys(author_key(x) for x in xs if x is not None) if k])
