"""Lines of a text, and the spelling under which two lines count as the same."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIGITS = re.compile(r"\d+")
_BLANK = re.compile(r"[^\S\n]+")
_IMAGE = re.compile(r"^\[\[img_0\]\]$")


def same_spelling(text: str) -> list[str]:
    """The lines of ``text`` after NFKC, case folding, removal of white space, and with each run of digits as ``0``."""
    # NFKC and case folding never make or take a line feed; other line separators are white space and vanish.
    return [_DIGITS.sub("0", _BLANK.sub("", line)) if line else "" for line in (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold().split("\n")]


@F.pandas_udf(T.ArrayType(T.StringType()))
def same_lines(texts: pd.Series) -> pd.Series:
    """Per text its lines in the common spelling; null for lines that are blank or only an image placeholder."""
    return texts.map(lambda t: None if t is None else [None if not s or s == "[[img_0]]" else s for s in same_spelling(t)])
