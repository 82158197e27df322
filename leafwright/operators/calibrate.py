"""Checks of the refusal thresholds: pages that must stay, pages that must go, and picture galleries put in place of articles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.pages import refusal
from leafwright.pages.decode import decode
from leafwright.pages.dom import parse

# The galleries that are tried: number of pictures, caption, introduction.
SHORT_CAPTION = "这是图说文字，描述本张新闻图片的现场画面与人物。"
LONG_CAPTION = "这是一段较长的图说文字，详细描述本张新闻图片拍摄的现场环境、人物动作、活动背景以及相关信息，字数接近真实图集页的图说长度。"
VARIANTS = (("short", 12, SHORT_CAPTION, ""), ("long", 10, LONG_CAPTION, ""), ("long with introduction", 9, LONG_CAPTION, "本图集记录活动现场精彩瞬间。" * 8))


def measured(pages: DataFrame) -> DataFrame:
    """(id, variant, expect_refusal, measures): each page as it is (null variant), and, if it is to stay, with each gallery in place of its article."""
    kind = f"array<struct<variant: string, measures: struct<{', '.join(x.replace(' ', ': ', 1) for x in refusal.MEASURES.split(', ', 8))}>>>"

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raws, expected in batches:
            out = []
            for raw, refuse in zip(raws, expected):
                html = decode(bytes(raw or b""))[0]
                own = [{"variant": None, "measures": refusal.measure(parse(html))}]
                for name, n, caption, intro in VARIANTS if not refuse else ():
                    root = parse(html)
                    refusal.as_photo_set(root, n, caption, intro)
                    own.append({"variant": name, "measures": refusal.measure(root)})
                out.append(own)
            yield pd.Series(out)

    each = F.pandas_udf(run, T._parse_datatype_string(kind))("raw", F.coalesce("expect_refusal", F.lit(False)))
    return pages.select("id", F.coalesce("expect_refusal", F.lit(False)).alias("expect_refusal"), F.explode(each).alias("m")).select("id", "m.variant", "expect_refusal", "m.measures")


def outcome(rows: DataFrame, limits: dict[str, float | Column] | None = None, *by: str) -> DataFrame:
    """(``by``, pages, false_refusals, missed_refusals, synthetic, missed_synthetic) of :func:`measured` rows under thresholds, which may be columns of ``rows``."""
    told = rows.withColumn("_no", refusal.verdict(F.col("measures"), limits).isNotNull())
    own, made = F.col("variant").isNull(), F.col("variant").isNotNull()
    return told.groupBy(*by).agg(
        F.count_if(own).alias("pages"),
        F.count_if(own & ~F.col("expect_refusal") & F.col("_no")).alias("false_refusals"),
        F.count_if(own & F.col("expect_refusal") & ~F.col("_no")).alias("missed_refusals"),
        F.count_if(made).alias("synthetic"),
        F.count_if(made & ~F.col("_no")).alias("missed_synthetic"),
    )


def calibrate(pages: DataFrame, limits: dict[str, float | Column] | None = None) -> DataFrame:
    """One row of :func:`outcome` for (id, site, raw, expect_refusal). Good thresholds have no false refusals and miss nothing."""
    return outcome(measured(pages), limits)


def sweep(pages: DataFrame, thresholds: DataFrame) -> DataFrame:
    """:func:`outcome` for each row of ``thresholds`` (a small table with ``run`` and columns named like thresholds): pages are measured once."""
    small = thresholds.collect()
    names = [c for c in thresholds.columns if c in refusal.THRESHOLDS]
    each = F.explode(F.array(*[F.struct(F.lit(r["run"]).alias("run"), *[F.lit(float(r[c])).alias(c) for c in names]) for r in small]))
    rows = measured(pages).select("*", each.alias("_t")).select("*", "_t.run")
    return outcome(rows, {c: F.col(f"_t.{c}") for c in names}, "run")
