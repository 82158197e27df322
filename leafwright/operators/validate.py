"""Rules that annotated pages must keep, as one projection of violation names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.columns import is_empty

# Domains of the fields and forms of times and offsets.
STRUCTURES = ("single", "multi", "list_page", "photo_set")
CONDITIONS = ("ok", "empty_shell", "anti_bot_suspected", "truncated", "dns_fail", "http_403")
RECORD_CONDITIONS = ("ok", "dns_fail", "http_403", "http_404", "redirect_loop", "shell_only")
TIME = "^\\d{4}-(?:\\d{2}|XX)-(?:\\d{2}|XX) (?:\\d{2}|XX):(?:\\d{2}|XX):(?:\\d{2}|XX)$"
OFFSET = "^[+-]\\d{2}:\\d{2}$"


def rules() -> dict[str, Column]:
    """Name and condition of each violation; a null condition is none."""
    publish, update = F.col("publish_time.value"), F.col("update_time.value")
    plain = publish.rlike(TIME) & update.rlike(TIME) & ~publish.contains("X") & ~update.contains("X")
    return {
        "structure_unknown": ~F.coalesce(F.col("content_structure").isin(*STRUCTURES), F.lit(False)),
        "condition_unknown": ~F.coalesce(F.col("page_condition").isin(*CONDITIONS), F.lit(False)),
        "title_missing": (F.col("content_structure") == "single") & (F.coalesce(F.col("title"), F.lit("")) == ""),
        "publish_form": publish.isNotNull() & ~publish.rlike(TIME),
        "update_form": update.isNotNull() & ~update.rlike(TIME),
        "publish_offset_form": F.col("publish_time.utc_offset").isNotNull() & ~F.col("publish_time.utc_offset").rlike(OFFSET),
        "update_before_publish": plain & (update < publish),
        "refusal_filled": F.col("expect_refusal") & (F.coalesce(F.col("content_text"), F.lit("")) != ""),
        "image_twice": F.size(F.array_distinct(F.regexp_extract_all("content_text", F.lit("\\[\\[IMG_\\d+\\]\\]"), F.lit(0)))) < F.size(F.regexp_extract_all("content_text", F.lit("\\[\\[IMG_\\d+\\]\\]"), F.lit(0))),
    }


# Fields of a full gold record, those that a refused page must leave empty, and the ids whose times may stand in the wrong order.
REQUIRED = [
    "id", "group", "site", "url", "path", "sha1", "page_condition", "needs_render", "content_structure", "expect_refusal", "title", "authors", "publish_time", "update_time", "content_text", "content_md", "conversion_flags", "images",
    "source", "provenance", "notes",
]
FILLED = ["title", "authors", "publish_time", "update_time", "content_text", "content_md", "images"]
INVERTED_OK = ["devto__01"]
INDEXED = ["group", "site", "url", "path", "sha1"]


def _empty(column: str, kind: str) -> Column:
    return is_empty(F.col(column), kind)


def record_rules(gold: DataFrame) -> dict[str, Column]:
    """Name and condition of each violation of a full gold record. Fields that ``gold`` lacks are told by :func:`missing_fields`, and rules about them are left out.

    ``missing:FIELD`` stands for provenance that a filled field lacks.
    """
    kinds = dict(gold.dtypes)
    has = lambda *names: all(n in kinds for n in names)
    refused = F.coalesce(F.col("expect_refusal"), F.lit(False)) if has("expect_refusal") else F.lit(False)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out: dict[str, Column] = {}
    for c in [c for c in FILLED if has(c)]:
        out[f"refusal_filled:{c}"] = refused & ~_empty(c, kinds[c])
        if has("provenance"):
            out[f"provenance_missing:{c}"] = ~refused & ~_empty(c, kinds[c]) & F.try_element_at("provenance", F.lit(c)).isNull()
    if has("provenance"):
        out["refusal_evidence_missing"] = refused & F.try_element_at("provenance", F.lit("refusal_evidence")).isNull()
        if has("source"):
            out["provenance_missing:source.publisher"] = ~refused & F.col("source.publisher").isNotNull() & F.try_element_at("provenance", F.lit("source.publisher")).isNull()
    if has("notes"):
        out["refusal_notes_missing"] = refused & (text("notes") == "")
    for c in ("title", "content_text", "content_md"):
        if has(c):
            out[f"article_empty:{c}"] = ~refused & (text(c) == "")
    if has("conversion_flags"):
        out["conversion_flags_missing"] = ~refused & F.col("conversion_flags").isNull()
    for c in ("publish_time", "update_time"):
        if has(c):
            value, offset = F.col(f"{c}.value"), F.col(f"{c}.utc_offset")
            out[f"{c}_form"] = ~refused & F.col(c).isNotNull() & ~F.coalesce(value.rlike(TIME), F.lit(False))
            out[f"{c}_offset_form"] = ~refused & offset.isNotNull() & ~offset.rlike(OFFSET)
            if "utc_offset_source" in kinds[c]:
                source = F.col(f"{c}.utc_offset_source")
                out[f"{c}_offset_source"] = ~refused & source.isNotNull() & (source != "inferred_site_locale")
                out[f"{c}_offset_source_alone"] = ~refused & source.isNotNull() & offset.isNull()
    if has("publish_time", "update_time"):
        whole = lambda c: F.when(~F.col(f"{c}.value").contains("XX"), F.concat(f"{c}.value", F.coalesce(F.col(f"{c}.utc_offset"), F.lit(""))))
        out["update_before_publish"] = ~refused & (whole("update_time") < whole("publish_time")) & ~F.col("id").isin(INVERTED_OK)
    if has("images", "content_text"):
        n = F.coalesce(F.size("images"), F.lit(0))
        marks = F.array_distinct(F.transform(F.regexp_extract_all(text("content_text"), F.lit("\\[\\[IMG_([0-9]+)\\]\\]"), F.lit(1)), lambda m: m.cast("int")))
        wanted = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        out["image_without_mark"] = ~refused & (F.size(F.array_except(wanted, marks)) > 0)
        out["mark_without_image"] = ~refused & (F.size(F.array_except(marks, wanted)) > 0)
        if has("content_md"):
            out["image_not_in_markdown"] = ~refused & (n > 0) & ~text("content_md").contains("[[IMG_1]]")
    if has("content_structure"):
        out["structure_unknown"] = ~F.coalesce(F.col("content_structure").isin(*STRUCTURES), F.lit(False))
    if has("page_condition"):
        out["condition_unknown"] = ~F.coalesce(F.col("page_condition").isin(*RECORD_CONDITIONS), F.lit(False))
    return out


def missing_fields(gold: DataFrame) -> list[str]:
    """Fields that a full gold record needs and ``gold`` lacks."""
    return [c for c in REQUIRED if c not in gold.columns]


def record_violations(gold: DataFrame, index: DataFrame) -> DataFrame:
    """(id, rule): violations of full gold records against :func:`record_rules` and against the page index.

    ``id_twice``, ``not_in_index`` and ``not_in_gold`` tell ids that repeat or that one side lacks, ``differs:FIELD`` fields that the two sides tell differently.
    """
    named = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in record_rules(gold).items()])
    own = gold.select("id", F.explode(F.array_compact(named)).alias("rule"))
    twice = gold.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit("id_twice").alias("rule"))
    shared = [c for c in INDEXED if c in gold.columns and c in index.columns]
    mine, known = gold.select("id", *[F.col(c).alias(f"_g_{c}") for c in shared]).distinct(), index.select("id", *shared, F.lit(True).alias("_known")).dropDuplicates(["id"])
    against = F.array(F.when(F.col("_known").isNull(), F.lit("not_in_index")), *[F.when(F.col("_known") & F.col("_g_id").isNotNull() & ~F.col(f"_g_{c}").eqNullSafe(F.col(c)), F.lit(f"differs:{c}")) for c in shared], F.when(F.col("_g_id").isNull(), F.lit("not_in_gold")))
    both = mine.withColumn("_g_id", F.col("id")).join(known, "id", "full").select("id", F.explode(F.array_compact(against)).alias("rule"))
    return own.unionByName(twice).unionByName(both)


def violations(gold: DataFrame) -> DataFrame:
    """(id, rule): one row per violated rule of each row of ``gold``, and ``id_twice`` for ids that stand on several rows."""
    named = F.array(*[F.when(c, F.lit(n)) for n, c in rules().items()])
    own = gold.select("id", F.explode(F.array_compact(named)).alias("rule"))
    twice = gold.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit("id_twice").alias("rule"))
    return own.unionByName(twice)
