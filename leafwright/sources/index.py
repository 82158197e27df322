"""Page index, gold records and prediction lines: readers, writers and the index update."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.pages.decode import decode
from leafwright.pages.dom import absolute_links, parse
from leafwright.session import broadcast_if_small

#: Splits of prediction files up to this many are broadcast (some 100 bytes each), more are joined by shuffle.
SPLITS_BROADCAST_ROWS = 100_000

RECORD = (
    "id string, dataset string, site string, route string, content_structure string, page_condition string, title string, authors array<string>, "
    "publish_time struct<value: string, utc_offset: string>, update_time struct<value: string, utc_offset: string>, content_text string"
)


def read_index(spark: SparkSession, path: str, groups: list[str] | None = None) -> DataFrame:
    """Index rows, a JSON object a line; the group filter runs before any page is read."""
    rows = spark.read.json(path)
    return rows.where(F.col("group").isin(*groups)) if groups else rows


def read_pages(spark: SparkSession, index: DataFrame, root: str) -> DataFrame:
    """The index with ``raw``, the bytes of each page below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "")
    return index.join(files.select(relative.alias("path"), F.col("content").alias("raw")), "path")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold records from a JSON file that holds a list, or an object with a list ``pages``."""
    text = spark.read.text(path, wholetext=True)
    pages = T.ArrayType(T._parse_datatype_string(RECORD))
    own = F.coalesce(F.from_json("value", T.StructType([T.StructField("pages", pages)]))["pages"], F.from_json("value", pages))
    return text.select(F.explode(own).alias("g")).select("g.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): the lines of text files with their numbers, from 1. Files of any size are read in splits.

    A line's place in its split follows from an id that grows by one from line to line; where a split begins in its file
    follows from the counts of the splits before it, one row a split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = broadcast_if_small(splits.select("file", "_start", "_first", before.alias("_before")), SPLITS_BROADCAST_ROWS)
    return lines.join(offsets, ["file", "_start"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def read_pred(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Prediction lines with ``line_no``, and (line_no, error, line) of the lines that are no JSON object or have no id. Blank lines are skipped."""
    schema = RECORD + ", rejected boolean"
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    read = lines.select("line_no", "line", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    error = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not JSON").when(F.col("r.id").isNull(), "no id")
    good = read.where(error.isNull()).select("line_no", "r.*").drop("_bad")
    return good, read.where(error.isNotNull()).select("line_no", error.alias("error"), "line")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys that ``new`` has, and all of ``new``. Null keys never match."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def describe(raw: Column) -> list[Column]:
    """``bytes``, ``sha1`` and ``encoding_declared`` of a page's bytes; the declaration is looked for in the first 8192."""
    head = F.decode(F.substring(raw, 1, 8192), "ISO-8859-1")
    declared = F.nullif(F.regexp_extract(head, """(?i)charset\\s*=\\s*["']?\\s*([\\w-]+)""", 1), F.lit(""))
    return [F.octet_length(raw).cast("long").alias("bytes"), F.sha1(raw).alias("sha1"), declared.alias("encoding_declared")]


def index_rows(fetched: DataFrame, note: Column | None = None) -> DataFrame:
    """Index rows of fetched pages (id, page_group, site, path, url, final_url, fetched_at, raw): sizes, hash, declared and detected encodings, visible characters."""
    kind = "struct<detected: string, visible: int>"

    def look(raws: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in raws:
            rows = []
            for raw in batch:
                text, _, detected, _ = decode(bytes(raw or b""))
                rows.append((detected, len(parse(text).text())))
            yield pd.DataFrame(rows, columns=["detected", "visible"])

    seen = fetched.withColumn("_seen", F.pandas_udf(look, kind)("raw"))
    kept = [c for c in ("id", "page_group", "site", "path", "url", "final_url", "fetched_at") if c in fetched.columns]
    return seen.select(*kept, *describe(F.col("raw")), F.col("_seen.detected").alias("encoding_detected"), F.col("_seen.visible").alias("visible_text"), (note if note is not None else F.lit("")).alias("note"))


def links(pages: DataFrame, pattern: str | None = None) -> DataFrame:
    """(site, url, page_id, position): the http(s) links of pages (id, site, url, raw), absolute and without fragment, each once a site where it stands first."""
    kind = "array<string>"

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raws, bases in batches:
            yield pd.Series([absolute_links(parse(decode(bytes(raw or b""))[0]), base or "", pattern) for raw, base in zip(raws, bases)])

    each = pages.select(F.col("id").alias("page_id"), "site", F.posexplode(F.pandas_udf(find, kind)("raw", "url")).alias("position", "url"))
    first = each.groupBy("site", "url").agg(F.min(F.struct("page_id", "position")).alias("_f"))
    return first.select("site", "url", "_f.page_id", "_f.position")


# What a fetched page must have, how many attempts a site has beyond its target, and how much of a page is read.
LEAST_BYTES, LEAST_VISIBLE, MORE_ATTEMPTS, FETCH_LIMIT, FETCH_CHUNK = 2000, 150, 10, 8 << 20, 64 << 10


def fetch_url(url: str) -> tuple[bytes, str]:
    """Bytes of a page, at most 8 MiB read in pieces of 64 KiB, and the address it was found at in the end."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "leafwright"}), timeout=30) as answer:  # noqa: S310
        parts, size = [], 0
        while size < FETCH_LIMIT and (part := answer.read(FETCH_CHUNK)):
            parts.append(part)
            size += len(part)
        return b"".join(parts)[:FETCH_LIMIT], answer.geturl()


def fetch(attempts: DataFrame, get: Callable[[str], tuple[bytes, str]] = fetch_url) -> DataFrame:
    """``attempts`` with ``raw``, ``final_url`` and ``fetch_error`` of each ``url``; ``get`` may be any callable. An error ends no batch."""
    kind = "struct<raw: binary, final_url: string, fetch_error: string>"

    def ask(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in urls:
            rows = []
            for url in batch:
                try:
                    raw, final = get(url)
                    rows.append((raw, final, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["raw", "final_url", "fetch_error"])

    return attempts.withColumn("_f", F.pandas_udf(ask, kind)("url")).select(*attempts.columns, "_f.*")


def gate(attempts: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(saved, failed) of fetch attempts (site, position, url, bytes, visible_text, fetch_error) in the order of ``position`` within a site.

    An attempt fails with its error, below 2000 bytes or below 150 visible characters. A site is tried until ``target`` (of
    ``targets``: site, target) pages are saved, at most target + 10 times; later attempts are left out of both tables.
    """
    reason = (
        F.when(F.col("fetch_error").isNotNull(), F.concat(F.lit("fetch:"), "fetch_error"))
        .when(F.coalesce("bytes", F.lit(0)) < LEAST_BYTES, F.concat(F.lit("too_small:"), F.coalesce("bytes", F.lit(0))))
        .when(F.coalesce("visible_text", F.lit(0)) < LEAST_VISIBLE, F.concat(F.lit("empty_shell_suspected:"), F.coalesce("visible_text", F.lit(0))))
    )
    order = Window.partitionBy("site").orderBy("position", "url")
    rows = attempts.join(targets.select("site", "target"), "site").withColumn("reason", reason)
    rows = rows.withColumn("_try", F.row_number().over(order)).where(F.col("_try") <= F.col("target") + MORE_ATTEMPTS)
    saved_before = F.coalesce(F.sum(F.col("reason").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_saved", saved_before).where(F.col("_saved") < F.col("target"))
    saved = rows.where("reason is null").withColumn("seq", (F.col("_saved") + 1).cast("int")).drop("reason", "_try", "_saved", "target")
    return saved, rows.where("reason is not null").select("site", "url", "reason")


def run_summary(saved: DataFrame, failed: DataFrame, targets: DataFrame) -> DataFrame:
    """(site, target, saved, failed): what a collecting run brought, a row a site of ``targets``."""
    count = lambda df, name: df.groupBy("site").agg(F.count("*").alias(name))
    return targets.select("site", "target").join(count(saved, "saved"), "site", "left").join(count(failed, "failed"), "site", "left").na.fill(0, ["saved", "failed"])


def sample_sites(index: DataFrame, order: str, sites: int = 80, pages: int = 2) -> DataFrame:
    """The first ``pages`` pages of the first ``sites`` sites, by where they first stand in ``order``, with ``site_rank`` and ``page_rank``.

    Sites are reduced to one row each before they are ranked.
    """
    first = index.where(F.col("site").isNotNull()).groupBy("site").agg(F.min(order).alias("_first")).orderBy("_first", "site").limit(sites)
    ranked = first.withColumn("site_rank", F.row_number().over(Window.orderBy("_first", "site"))).drop("_first")  # at most ``sites`` rows
    own = Window.partitionBy("site").orderBy(order)
    return index.join(F.broadcast(ranked), "site").withColumn("page_rank", F.row_number().over(own)).where(F.col("page_rank") <= pages)
