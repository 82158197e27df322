"""Queries of the operators for language-model training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import encoding, furniture, mixing, packing, repetition, residue, sitelines
from leafwright.llm.tokencount import count_tokens
from leafwright.session import cut
from leafwright.sources.tables import table


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """id, site, title and content_text of mini_gold; a null site is taken from the id, which begins with it."""
    site = F.coalesce("site", F.nullif(F.regexp_extract("id", "^(.*)__", 1), F.lit("")))
    return table(spark, folder, "mini_gold", "id", "site", "title", "content_text").withColumn("site", site)


def _encodings(spark: SparkSession, folder: str) -> encoding.Model:
    """The model of wrong encodings, counted over all texts."""
    return encoding.fit(table(spark, folder, "mini_gold", "content_text"), "content_text")


def _fitted(spark: SparkSession, folder: str, residue_only: bool) -> residue.Fitted:
    """The models that p2 (``residue_only``) or p4 judges pages by; p2's weigh words by their frequencies, p4 needs furniture, too."""
    return residue.fit(_pages(spark, folder), "content_text", "site", words=residue_only, furniture=not residue_only)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose text holds residue, filler, an error message or a notice, and no article."""
    return residue.residue_pages(_pages(spark, folder), "id", "content_text", "site", _fitted(spark, folder, True))


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and lengths of the pages that stay."""
    kept = residue.exclude_residue(_pages(spark, folder), "id", "content_text", "site", _fitted(spark, folder, True))
    return kept.select("id", F.length("content_text").alias("n_characters")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank lines that aren't part of the article."""
    return furniture.furniture_lines(_pages(spark, folder), "id", "content_text", "site", "title", _fitted(spark, folder, False))


def p4_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The article alone of each page."""
    return furniture.main_text(_pages(spark, folder), "id", "content_text", "site", "title", _fitted(spark, folder, False)).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that hold garbled characters, restorable or not."""
    return p3_restored(spark, folder).select("id", "line_no")


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled lines with the pair of encodings that garbled them and, where nothing was lost, their original wording."""
    gold = table(spark, folder, "mini_gold", "id", "content_text")
    return encoding.garbled_lines(gold, "id", "content_text", _encodings(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that stand on at least 4 pages and 10 % of the pages of their site."""
    gold = table(spark, folder, "mini_gold", "id", "site", "content_text", "annotated_at")
    pages = cut(sitelines.line_hashes(gold, "id", "site", "content_text", "annotated_at"))
    return sitelines.excess_occurrences(pages, "id", "site")


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without the lines that their site repeats too often, and how many lines were removed."""
    gold = table(spark, folder, "mini_gold", "id", "site", "content_text", "annotated_at")
    return sitelines.remove_excess_lines(gold, "id", "site", "content_text", "annotated_at").distinct()


def _sizes(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text", *more).withColumn("tokens", count_tokens(F.col("text")))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each text, for each container size."""
    return packing.pack(_sizes(spark, folder).select("doc_id", "tokens"), table(spark, folder, "pack_spec"))


def p7_use(spark: SparkSession, folder: str) -> DataFrame:
    """What each container holds and leaves free."""
    return packing.use(p7_containers(spark, folder), table(spark, folder, "pack_spec"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each size are, and how few could hold the tokens."""
    return packing.fill(p7_use(spark, folder), table(spark, folder, "pack_spec"))


def p8_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of each mix and how often each is used."""
    return mixing.mix(_sizes(spark, folder, "source"), table(spark, folder, "mix_target"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the sources of each mix reach."""
    return mixing.mix(_sizes(spark, folder, "source"), table(spark, folder, "mix_target"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least 30 % of their characters in passages that occurred earlier in the same text."""
    measured = repetition.measure(table(spark, folder, "documents", "doc_id", "text"), "text")
    found = F.explode(F.when(repetition.RULES[0].broken(), F.array("doc_id")))  # a filter would be pushed below and repeat the measures
    return measured.select(found.alias("doc_id"))


def p9_measures(spark: SparkSession, folder: str) -> DataFrame:
    """All measures of each document and the rules that it breaks."""
    return repetition.judge(table(spark, folder, "documents", "doc_id", "text"), "text").drop("text")


QUERIES = {f.__name__: f for f in (p2_found, p2_kept, p4_found, p4_articles, p3_found, p3_restored, p5_found, p5_texts, p7_containers, p7_use, p7_fill, p8_records, p8_shares, p9_found, p9_measures)}
ORACLES: dict[str, str] = {}
