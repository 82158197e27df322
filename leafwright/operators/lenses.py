"""Two other ways to score the same pairs: an older, laxer one and one by words."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.functions.texts import in_order, overlap
from leafwright.operators import scoring

_BRACKETS = re.compile(r"[（(][^）)]*[）)]")


def lower_text(text: str) -> str:
    return "".join(unicodedata.normalize("NFKC", text).lower().split())


def lower_name(name: str) -> str:
    return "".join(_BRACKETS.sub("", unicodedata.normalize("NFKC", name).lower()).split())


def set_f1(pred: set[str], gold: set[str]) -> float | None:
    """Null if both are empty."""
    if not pred and not gold:
        return None
    return 2 * len(pred & gold) / (len(pred) + len(gold))


def word_runs(text: str, n: int = 4) -> Counter:
    """Runs of ``n`` words with their counts; a shorter text is one run."""
    words = text.split()
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def word_f1(pred: str, gold: str, n: int = 4) -> float:
    return overlap(word_runs(pred, n), word_runs(gold, n))[2]


def day_score(pred: Column, gold: Column) -> Column:
    """Whether two written times name the same day; null if either doesn't name one."""
    a, b = F.left(pred, F.lit(10)), F.left(gold, F.lit(10))
    named = lambda x: (F.length(x) == 10) & ~x.contains("X")
    return F.when(named(a) & named(b), (a == b).cast("double"))


_OLD = T.StructType([T.StructField(x, T.DoubleType()) for x in ("title", "authors", "content")])
_WORDS = T.StructType([T.StructField(x, T.DoubleType()) for x in ("title", "authors", "content")])


def _names(xs, key) -> set[str]:
    return {k for k in (key(x) for x in (xs if xs is not None else []) if x is not None) if k}


@F.pandas_udf(_OLD)
def _old(pt: pd.Series, gt: pd.Series, pa: pd.Series, ga: pd.Series, pc: pd.Series, gc: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, x, y, c, d in zip(pt, gt, pa, ga, pc, gc):
        title = None if not b else float(lower_text(a or "") == lower_text(b))
        wanted = lower_text(d or "")
        content = in_order(lower_text(c or ""), wanted) if wanted else None
        rows.append((title, set_f1(_names(x, lower_name), _names(y, lower_name)), content))
    return pd.DataFrame(rows, columns=_OLD.names, dtype="float64")


@F.pandas_udf(_WORDS)
def _words(pt: pd.Series, gt: pd.Series, pa: pd.Series, ga: pd.Series, pc: pd.Series, gc: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, x, y, c, d in zip(pt, gt, pa, ga, pc, gc):
        gold = _names(y, lambda n: n.lower().strip())
        rows.append((None if not b else word_f1(a or "", b), None if not gold else set_f1(_names(x, lambda n: n.lower().strip()), gold), None if not d else word_f1(c or "", d)))
    return pd.DataFrame(rows, columns=_WORDS.names, dtype="float64")


def _joined(gold: DataFrame, pred: DataFrame) -> DataFrame:
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("title", "authors", "content_text")], F.col("publish_time.value").alias(f"{p}_publish"))
    return side(gold, "g").join(side(pred, "p"), F.col("g_id") == F.col("p_id"), "left")


def score_lax(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, title, authors, publish, content): exact title, set F1 of names with their introducing words, same day, matching blocks in order.

    What gold lacks is skipped (null). A missing prediction has content 0; texts may have any length.
    """
    s = _old("p_title", "g_title", "p_authors", "g_authors", "p_content_text", "g_content_text")
    rows = _joined(gold, pred).select(F.col("g_id").alias("id"), day_score(F.col("p_publish"), F.col("g_publish")).alias("publish"), s.alias("s"))
    return rows.select("id", "s.title", "s.authors", "publish", "s.content")


def score_days(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, publish) of :func:`score_lax`; reads ids and publication times only."""
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("publish_time.value").alias(f"{p}_publish"))
    both = side(gold, "g").join(side(pred, "p"), F.col("g_id") == F.col("p_id"), "left")
    return both.select(F.col("g_id").alias("id"), day_score(F.col("p_publish"), F.col("g_publish")).alias("publish"))


LAX = ("title", "authors", "publish", "content")


def lax_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The five views of the lax lens: pages, scored pages, mean and number of each score, accuracy of refusals.

    Pages to refuse count for refusals only. A score that is skipped counts nowhere.
    """
    facts = scoring.refusals(gold, pred)
    scores = score_lax(gold, pred).withColumnRenamed("id", "_id")
    both = facts.join(scores, F.col("id") == F.col("_id")).drop("_id")
    both = both.select(*[F.coalesce(F.col(v).cast("string"), F.lit("unknown")).alias(v) for v in scoring.VIEWS], "refuse", "refusal_correct", *[F.when(~F.col("refuse"), F.col(c)).alias(c) for c in LAX])
    told = [F.count("*").alias("n_pages"), F.count_if(~F.col("refuse")).alias("n_scored"), F.avg("refusal_correct").alias("refusal_accuracy")]
    told += [x for c in LAX for x in (F.avg(c).alias(c), F.count(c).alias(f"{c}_n"))]
    return scoring.views(both, told)


def score_words(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, title, authors, content): F1 of runs of four words, set F1 of names. What gold lacks is skipped, a missing prediction has 0."""
    s = _words("p_title", "g_title", "p_authors", "g_authors", "p_content_text", "g_content_text")
    return _joined(gold, pred).select(F.col("g_id").alias("id"), s.alias("s")).select("id", "s.*")
