"""Pages and predictions as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.pages.record import RULES, SiteRule, extract


def extract_stream(pages: DataFrame, rules: tuple[SiteRule, ...] = RULES) -> DataFrame:
    """Records of a stream of (id, site, raw); no state, so append mode fits."""
    return extract(pages, rules)


def first_fetches(index: DataFrame, late: str = "10 days") -> DataFrame:
    """Each page's first row within ``late`` of the newest ``fetched_at``; later repeats are dropped, as state is with the watermark."""
    return index.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["id"])


def arrivals(index: DataFrame, late: str = "10 days", window: str = "1 day") -> DataFrame:
    """Pages and bytes by site and window of ``fetched_at``; rows later than ``late`` are left out."""
    span = F.window("fetched_at", window)
    return index.withWatermark("fetched_at", late).groupBy(span.alias("w"), "site").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), "site", "pages", "bytes")
