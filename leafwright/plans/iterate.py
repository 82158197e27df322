"""One round of improving the extractor: extract, score, check, compare arms, append to the history."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators import scoring
from leafwright.pages import gold as tools
from leafwright.pages import readable as main_text
from leafwright.pages import record
from leafwright.pages.dom import Node


def negative_check(records: DataFrame, ids: list[str]) -> DataFrame:
    """(id, rejected, correct_refusal): whether each of a few pages that hold no article was refused or left empty; a page without a record was."""
    blank = (F.coalesce("title", F.lit("")) == "") & (F.coalesce(F.size("authors"), F.lit(0)) <= 0) & (F.coalesce("content_text", F.lit("")) == "") & F.col("publish_time").isNull()
    asked = records.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    own = records.where(F.col("id").isin(ids)).select("id", "rejected", blank.alias("_blank"))
    return asked.join(own, "id", "left").select("id", F.coalesce("rejected", F.lit(False)).alias("rejected"), (F.coalesce("rejected", F.lit(False)) | F.coalesce("_blank", F.lit(True))).alias("correct_refusal"))


def control_arm(pages: DataFrame) -> DataFrame:
    """Records of an extractor that knows no site and no metadata: the title of the page's head and what reads like its main text; times and authors stay null."""

    def of(root: Node, _: str) -> dict:
        title, node = root.first("title"), main_text.readable(root)
        text = "\n".join(x for x in (t.strip() for t in node.text("\n").split("\n")) if x) if node is not None else ""
        return {"title": (title.text() or None) if title is not None else None, "content_text": text or None}

    own = tools._per_page(pages, of, "title string, content_text string", "raw", "id")
    none = F.lit(None).cast(record.TIME)
    return pages.select("id", own.alias("_c")).select("id", "_c.title", F.lit(None).cast("array<string>").alias("authors"), none.alias("publish_time"), none.alias("update_time"), "_c.content_text", F.lit(False).alias("rejected"))


MAIN = ("title_exact", "title_sim", "authors_f1", "publish_time_score", "update_time_score", "content_f1", "lcs_f1", "refusal_accuracy")


def arms(gold: DataFrame, predictions: dict[str, DataFrame]) -> DataFrame:
    """(metric, one column an arm): the overall scores of several extractors side by side."""
    told = [scoring.report(scoring.score_pages(gold, pred)).where("view = 'overall'").select(F.lit(name).alias("arm"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in MAIN])).alias("x")) for name, pred in predictions.items()]
    rows = told[0]
    for more in told[1:]:
        rows = rows.unionByName(more)
    return rows.select("arm", "x.*").groupBy("metric").pivot("arm", list(predictions)).agg(F.first("score"))


def stage_times(read: DataFrame) -> DataFrame:
    """(stage, pages, seconds, mean_ms, max_ms) of the ``ms`` that :func:`leafwright.pages.record.read` notes a page."""
    each = read.where(F.col("ms").isNotNull()).select(F.explode("ms").alias("stage", "v"))
    return each.groupBy("stage").agg(F.count("*").alias("pages"), F.round(F.sum("v") / 1000, 3).alias("seconds"), F.round(F.avg("v"), 3).alias("mean_ms"), F.max("v").alias("max_ms"))


HISTORY = "version string, note string, started timestamp, pages long, seconds double, pages_per_minute double, scores map<string, double>, negative_correct int, negative_total int"


def iterate(pages: DataFrame, gold: DataFrame, history: str, version: str, note: str = "", negatives: list[str] | None = None, limits: dict[str, float | Column] | None = None) -> DataFrame:
    """Extracts ``pages``, scores the records against ``gold``, checks ``negatives`` and appends a row to the parquet table ``history``, which is returned whole."""
    spark = pages.sparkSession
    began = time.time()
    records = record.extract(pages, limits=limits).cache()
    n = records.count()
    took = time.time() - began
    shown = scoring.report(scoring.score_pages(gold, records)).where("view = 'overall'").select(*MAIN).first()
    negative = negative_check(records, negatives or []).agg(F.count_if("correct_refusal").alias("a"), F.count("*").alias("b")).first()
    scores = {m: float(shown[m]) for m in MAIN if shown[m] is not None}
    row = spark.createDataFrame([(version, note, None, n, round(took, 3), round(60 * n / took, 1), scores, int(negative.a), int(negative.b))], HISTORY).withColumn("started", F.timestamp_seconds(F.lit(began)))
    row.write.mode("append").parquet(history)
    records.unpersist()
    return spark.read.parquet(history)
