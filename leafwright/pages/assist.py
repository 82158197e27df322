"""A model's help where rules leave a gap: who is asked, and what of the answer holds.

The model is any callable that takes a page's text and answers a dictionary with ``title``, ``authors`` and ``publish_time``, or
null. Nothing of an answer is taken that doesn't stand on the page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.columns import date_on_page, let, spoken_time, stripped
from leafwright.pages import names

WEAK_TITLE = "dom://title"
ANSWER = "struct<title: string, authors: array<string>, publish_time: string, failed: boolean>"


def gaps() -> dict[str, Column]:
    """The fields that a record lacks and that no rule has decided to leave empty."""
    open_field = lambda f: ~F.array_contains("final_fields", f)
    weak = F.col("title").isNull() | F.coalesce(F.try_element_at("provenance", F.lit("title")) == WEAK_TITLE, F.lit(False))
    return {"title": open_field("title") & weak, "authors": open_field("authors") & F.col("authors").isNull(), "publish_time": open_field("publish_time") & F.col("publish_time").isNull()}


def needs_model() -> Column:
    """Whether a record that isn't refused or broken lacks a field that a model may be asked for."""
    lacking = gaps()
    return ~F.col("rejected") & F.col("error").isNull() & (lacking["title"] | lacking["authors"] | lacking["publish_time"])


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "\\s+", ""))


def accepted(answer: Column, page_text: Column, site: Column) -> dict[str, Column]:
    """What of an answer holds: a title of 4 to 200 characters that stands on the page; names that stand alone on one of its lines and are no media, site,
    network, date or person spoken of politely; a time of which the page shows the wording or the day."""
    page = _bare(page_text)
    title = stripped(answer["title"])
    name = F.lower(F.coalesce(site, F.lit("")))
    lines = names.short_lines(page_text)

    def fits(n: Column) -> Column:
        own = F.regexp_replace(F.lower(n), " ", "").isin(name, F.substring_index(name, ".", 1))
        return F.length(n).between(2, 40) & page.contains(_bare(n)) & ~names.is_media(n) & ~own & ~F.coalesce(names.category(n), F.lit("")).isin("social", "month") & ~n.rlike(names.HONORIFIC) & names.stands_alone(n, lines)

    written = stripped(answer["publish_time"])

    def held(time: Column) -> Column:
        shown = page.contains(_bare(written)) | date_on_page(time["value"], page_text)
        return F.when((written != "") & time.isNotNull() & shown, F.struct(time["value"].alias("value"), time["utc_offset"].alias("utc_offset"), F.lit(None).cast("string").alias("utc_offset_source")))

    people = F.array_sort(F.array_distinct(F.filter(F.transform(answer["authors"], stripped), fits)))
    return {
        "title": F.when(F.length(title).between(4, 200) & page.contains(_bare(title)), title),
        "authors": let(people, lambda x: F.when(F.size(x) > 0, x)),
        "publish_time": let(spoken_time(written), held),
    }


def assist(records: DataFrame, ask: Callable[[str], dict | None] | None) -> DataFrame:
    """``records`` (of :func:`leafwright.pages.record.resolve`) with the gaps filled that ``ask`` can fill, ``asked`` (whether it was called), ``ask_failed`` (it
    raised an error or gave no dictionary) and ``filled`` (the fields taken). Without a model nothing is asked. ``route`` and ``provenance`` tell what the model gave."""
    if ask is None:
        return records.withColumns({"asked": F.lit(False), "ask_failed": F.lit(False), "filled": F.array().cast("array<string>")})

    @F.pandas_udf(ANSWER)
    def answers(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                row: dict = {"title": None, "authors": None, "publish_time": None, "failed": None}
                if text is not None:
                    try:
                        got = ask(text)
                        row["failed"] = not isinstance(got, dict)
                        if isinstance(got, dict):
                            row["title"] = got.get("title") if isinstance(got.get("title"), str) else None
                            row["publish_time"] = got.get("publish_time") if isinstance(got.get("publish_time"), str) else None
                            row["authors"] = [n for n in got["authors"] if isinstance(n, str)] if isinstance(got.get("authors"), list) else None
                    except Exception:  # noqa: BLE001  a model that fails leaves the record as it is
                        row["failed"] = True
                rows.append(row)
            yield pd.DataFrame(rows, columns=["title", "authors", "publish_time", "failed"])

    rows = records.withColumn("asked", F.coalesce(needs_model(), F.lit(False)))
    rows = rows.withColumn("_a", answers(F.when(F.col("asked"), F.coalesce("page_text", F.lit("")))))
    lacking, held = gaps(), accepted(F.col("_a"), F.col("page_text"), F.col("site"))
    rows = rows.withColumns({f"_{f}": F.when(F.col("asked") & lacking[f], held[f]) for f in lacking})
    filled = F.array_compact(F.array(*[F.when(F.col(f"_{f}").isNotNull(), f) for f in lacking]))
    rows = rows.withColumn("filled", filled)
    known = F.map_from_entries(F.transform("filled", lambda f: F.struct(f.alias("key"), F.lit("model").alias("value"))))
    kept = F.map_filter(F.coalesce("provenance", F.create_map().cast("map<string, string>")), lambda k, _: ~F.array_contains("filled", k))
    new = {f: F.coalesce(f"_{f}", f) for f in lacking}
    return rows.withColumns({
        **new, "ask_failed": F.coalesce("_a.failed", F.lit(False)), "provenance": F.when(F.size("filled") > 0, F.map_concat(kept, known)).otherwise(F.col("provenance")),
        "route": F.when(F.size("filled") > 0, F.concat("route", F.lit("+model["), F.array_join("filled", ","), F.lit("]"))).otherwise(F.col("route")),
    }).drop("_a", *[f"_{f}" for f in lacking])


def help_stats(assisted: DataFrame) -> DataFrame:
    """(pages, asked, failed, filled_title, filled_authors, filled_publish_time): how often a model was asked and what came of it."""
    return assisted.agg(F.count("*").alias("pages"), F.count_if("asked").alias("asked"), F.count_if("ask_failed").alias("failed"), *[F.count_if(F.array_contains("filled", f)).alias(f"filled_{f}") for f in gaps()])
