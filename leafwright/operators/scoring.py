"""Scores of predicted records against gold records, and their report.

Gold and predictions meet in one left join; a page without a prediction scores as an empty one. Pages that should be
refused are scored for refusal only, the others field by field. The report is one grouping-sets
aggregation over all pages, by dataset, site, route and structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.functions.columns import field_tag, is_empty, paragraph_ratio, share, should_reject, time_confused, time_score, time_tag, zone_status
from leafwright.functions.texts import author_keys, compare_texts, in_order_f1, normal_text


VIEWS = ("dataset", "site", "route", "content_structure")


def newest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per non-null key, the first by ``order``; of equals the one with the greatest hash of all columns.

    Rows are moved by ``key`` once, and a join on it needs no second move. Whatever columns ``df`` has are moved, so
    select those that are wanted first.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, F.xxhash64(*df.columns).desc()))
    return df.where(F.col(key).isNotNull()).withColumn("_n", rank).where("_n = 1").drop("_n")


def last_line(pred: DataFrame, key: str = "id", line: str = "line_no") -> DataFrame:
    """The last line of each id; lines without an id are dropped."""
    return newest(pred, key, F.col(line).desc_nulls_last())


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key: the one with the greatest ``at``."""
    return newest(df, key, F.col(at).desc_nulls_last())


def time_fields(gold: DataFrame) -> list[str]:
    return sorted(c for c in gold.columns if c.endswith("_time"))


def structured_times(df: DataFrame, times: list[str]) -> DataFrame:
    """``df`` with written times as structs; a plain string is a value without an offset."""
    plain = [c for c, kind in df.dtypes if c in times and kind == "string"]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), F.lit(None).cast("string").alias("utc_offset"))) for c in plain}) if plain else df


def _authors_f1(pred: Column, gold: Column) -> Column:
    p, g = F.coalesce(pred, F.array().cast("array<string>")), F.coalesce(gold, F.array().cast("array<string>"))
    common = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), None).when(common == 0, 0.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def refusals(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, dataset, site, route, content_structure, refuse, refusal_correct): whether each gold page should be refused and, if so, whether it was.

    A page is refused if its prediction is missing, says so, or is empty in every field.
    """
    times = time_fields(gold)
    fields = ["title", "authors", "content_text", *times]
    kinds = dict(pred.dtypes)
    blank = F.lit(True)
    for c in fields:
        blank = blank & is_empty(F.col(c), kinds[c])
    said = pred.select(F.col("id").alias("_id"), (F.coalesce("rejected", F.lit(False)) | blank).alias("_said"))
    refuse = should_reject(F.col("content_structure"), F.col("page_condition"))
    both = gold.select("id", *VIEWS, refuse.alias("refuse")).join(said, F.col("id") == F.col("_id"), "left")
    return both.select("id", *VIEWS, "refuse", F.when(F.col("refuse"), F.coalesce("_said", F.lit(True)).cast("int")).alias("refusal_correct"))


def score_pages(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row per gold page with the tags and scores of every field.

    ``gold`` has id, dataset, site, route, content_structure, page_condition, title, authors, content_text and structs
    ``*_time`` (value, utc_offset, or a plain string without an offset), one row per id; ``pred`` the same fields and ``rejected``, one row per id.
    Scores are null where they don't count. A gold time without a known part is tagged ``gold_all_xx`` and neither scored nor counted for its zone.
    """
    times = time_fields(gold)
    fields = ["title", "authors", "content_text", *times]
    gold, pred = (structured_times(df, times) for df in (gold, pred))
    kinds = dict(gold.dtypes)
    g = gold.select("id", *[F.col(c) for c in ("dataset", "site", "route", "content_structure", "page_condition")], *[F.col(c).alias(f"g_{c}") for c in fields])
    p = pred.select(F.col("id").alias("_id"), "rejected", *[F.col(c).alias(f"p_{c}") for c in fields])
    both = g.join(p, g["id"] == p["_id"], "left")
    blank = F.lit(True)
    for c in fields:
        blank = blank & is_empty(F.col(f"p_{c}"), kinds[c])
    both = both.withColumn("refuse", should_reject(F.col("content_structure"), F.col("page_condition")))
    both = both.withColumn("refused", F.col("_id").isNull() | F.coalesce(F.col("rejected"), F.lit(False)) | blank)
    both = both.withColumn("refusal_correct", F.when(F.col("refuse"), F.col("refused").cast("int")))
    scored = ~F.col("refuse")
    tag = {c: F.when(scored, field_tag(F.col(f"p_{c}"), F.col(f"g_{c}"), kinds[c])) for c in ("title", "authors", "content_text")}
    for c in times:
        tag[c] = F.when(scored, time_tag(F.col(f"p_{c}.value"), F.col(f"g_{c}.value")))
    for c, t in tag.items():
        both = both.withColumn(f"{c}_tag", t)
    present = lambda c: F.col(f"{c}_tag") == "ok"
    void = lambda c: F.col(f"{c}_tag").isin("miss", "false_fill")
    filled = present("content_text") | (F.col("content_text_tag") == "false_fill")  # what is filled in wrongly still repeats itself or not
    both = both.withColumn("_title", F.when(present("title"), compare_texts("p_title", "g_title"))).withColumn("_content", F.when(filled, compare_texts("p_content_text", "g_content_text")))
    exact = F.when(present("title"), (normal_text("p_title") == normal_text("g_title")).cast("double")).when(void("title"), 0.0)
    both = both.withColumn("title_exact", exact).withColumn("title_sim", F.when(present("title"), F.col("_title.f1")).when(F.col("title_tag") == "miss", 0.0))
    both = both.withColumn("authors_f1", F.when(present("authors"), _authors_f1(author_keys("p_authors"), author_keys("g_authors"))).when(void("authors"), 0.0))
    both = both.withColumn("content_f1", F.when(present("content_text"), F.col("_content.f1")).when(void("content_text"), 0.0))
    both = both.withColumn("lcs_f1", F.when(present("content_text"), in_order_f1("p_content_text", "g_content_text")))
    both = both.withColumn("dup_ratio", F.col("_content.dup_ratio")).withColumn("num_f1", F.when(present("content_text"), F.col("_content.num_f1")))
    both = both.withColumn("para_ratio", F.when(present("content_text"), paragraph_ratio(F.col("p_content_text"), F.col("g_content_text"))))
    for c in times:
        others = [F.coalesce(time_confused(F.col(f"p_{c}.value"), F.col(f"g_{o}.value")), F.lit(False)) for o in times if o != c]
        confused = others[0] if others else F.lit(False)
        for o in others[1:]:
            confused = confused | o
        both = both.withColumn(f"{c}_score", F.when(present(c), time_score(F.col(f"p_{c}.value"), F.col(f"g_{c}.value"))).when(void(c), 0.0))
        both = both.withColumn(f"{c}_confused", F.when(present(c), confused).when(F.col(f"{c}_tag") == "miss", False))
        both = both.withColumn(f"{c}_zone", F.when(present(c) | (F.col(f"{c}_tag") == "miss"), zone_status(F.col(f"p_{c}.utc_offset"), F.col(f"g_{c}.utc_offset"))))
    return both.drop("_id", "_title", "_content", "rejected", *[f"{x}_{c}" for x in "gp" for c in fields])


TAGS = ("correct_empty", "false_fill", "miss", "ok", "gold_all_xx")
ZONES = ("match", "missing", "mismatch", "gold_absent")


def report(scores: DataFrame) -> DataFrame:
    """The five views of :func:`score_pages`: overall and by each of :data:`VIEWS`, from one pass.

    ``view`` and ``value`` name the group; means skip nulls; ``*_miss_rate`` is over pages whose gold field is present,
    ``*_false_fill_rate`` over pages whose gold field is empty. ``*_tags`` and ``*_zones`` hold counts, ``*_confusions`` the pages
    whose time is gold's other time, ``refusals`` the pages to refuse and those refused. Rows come in order of view and value.
    """
    named = scores.select([F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) if c in VIEWS else F.col(c) for c in scores.columns])
    tags = [c for c in scores.columns if c.endswith("_tag")]
    means = [c for c in scores.columns if c.endswith("_score") or c in ("title_exact", "title_sim", "authors_f1", "content_f1", "lcs_f1", "dup_ratio", "num_f1", "para_ratio")]
    aggregates = [F.count("*").alias("n_pages"), F.count_if(~F.col("refuse")).alias("n_scored"), F.avg("refusal_correct").alias("refusal_accuracy")]
    aggregates += [F.avg(c).alias(c) for c in means]
    for c in tags:
        name = c[: -len("_tag")]
        aggregates += [
            share(F.count_if(F.col(c) == "miss"), F.count_if(F.col(c).isin("miss", "ok"))).alias(f"{name}_miss_rate"),
            share(F.count_if(F.col(c) == "false_fill"), F.count_if(F.col(c).isin("false_fill", "correct_empty"))).alias(f"{name}_false_fill_rate"),
            F.struct(*[F.count_if(F.col(c) == t).alias(t) for t in TAGS]).alias(f"{name}_tags"),
        ]
    for c in (c for c in scores.columns if c.endswith("_zone")):
        aggregates.append(F.struct(*[F.count_if(F.col(c) == z).alias(z) for z in ZONES]).alias(f"{c}s"))
    aggregates += [F.count_if(F.col(c)).alias(f"{c[: -len('_confused')]}_confusions") for c in scores.columns if c.endswith("_confused")]
    aggregates.append(F.struct(F.count("refusal_correct").alias("n"), F.count_if(F.col("refusal_correct") == 1).alias("correct")).alias("refusals"))
    return views(named, aggregates)


def views(rows: DataFrame, aggregates: list[Column]) -> DataFrame:
    """(view, value, aggregates) over all rows and by each of :data:`VIEWS`, in one pass and in order."""
    sets = rows.groupingSets([[], *[[F.col(v)] for v in VIEWS]], *[F.col(v) for v in VIEWS]).agg(F.grouping_id().alias("_g"), *aggregates)
    view = F.when(F.col("_g") == 15, "overall")
    for i, v in enumerate(VIEWS):
        view = view.when(F.col("_g") == 15 - (8 >> i), v)
    value = F.when(F.col("_g") == 15, "all").otherwise(F.coalesce(*[F.col(v) for v in VIEWS]))
    told = sets.select(view.alias("view"), value.alias("value"), *[c for c in sets.columns if c not in (*VIEWS, "_g")])
    return told.orderBy(F.array_position(F.array(*[F.lit(v) for v in ("overall", *VIEWS)]), F.col("view")), "value")


def bad_refusals(scores: DataFrame) -> DataFrame:
    """(view, value, id): the pages that should have been refused and weren't, under each view; a table, as their number is unbounded."""
    views = F.explode(F.array(F.struct(F.lit("overall").alias("view"), F.lit("all").alias("value")), *[F.struct(F.lit(v).alias("view"), F.coalesce(F.col(v).cast("string"), F.lit("unknown")).alias("value")) for v in VIEWS]))
    return scores.where("refusal_correct = 0").select("id", views.alias("_v")).select("_v.view", "_v.value", "id")


def changed(before: DataFrame, after: DataFrame, measure: str) -> DataFrame:
    """(id, before, after, change): pages whose ``measure`` differs between two score tables; a page in one only has a null."""
    a, b = before.select("id", F.col(measure).alias("before")), after.select("id", F.col(measure).alias("after"))
    both = a.join(b, "id", "full").withColumn("change", F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
