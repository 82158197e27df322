"""Queries of the operators that belong to the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwright.functions.columns import paragraphs, should_reject, smaller_share, time_confused, time_score, written_time, zone_status
from leafwright.operators import lenses, scoring
from leafwright.operators.instants import to_utc
from leafwright.operators.medians import medians
from leafwright.operators.packed import may_be_packed, split_packed
from leafwright.operators.validate import violations
from leafwright.sources.index import upsert
from leafwright.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every author of a field that packs two or more authors in one string."""
    gold = table(spark, folder, "mini_gold", "id", "authors").where(F.exists("authors", lambda a: may_be_packed(a)))
    raw = F.col("trafilatura.four_field_mapping.authors_raw")
    dev = table(spark, folder, "dev5_validation", "id", "trafilatura").where(may_be_packed(raw)).select("id", F.array(raw).alias("authors"))
    both = gold.select(F.lit("mini_gold").alias("src"), "*").unionByName(dev.select(F.lit("dev5_validation").alias("src"), "*"))
    return split_packed(both, ["src", "id"], "authors").where("packed").drop("packed")


def _times(spark: SparkSession, folder: str) -> DataFrame:
    """(src, id, line_no, value, utc_offset, site, tz_name, date_order) of publish_time in mini_gold and update_time in mini_pred."""
    gold = table(spark, folder, "mini_gold", "id", "site", "publish_time").distinct()
    pages = gold.groupBy("id").agg(F.max("site").alias("site"))
    pred = table(spark, folder, "mini_pred", "id", "line_no", "update_time").where("update_time.value is not null").join(pages, "id", "left")
    both = gold.where("publish_time.value is not null").select(F.lit("mini_gold").alias("src"), "id", F.lit(0).cast("long").alias("line_no"), "publish_time.value", "publish_time.utc_offset", "site").unionByName(
        pred.select(F.lit("mini_pred").alias("src"), "id", "line_no", "update_time.value", "update_time.utc_offset", "site")
    )
    return both.join(table(spark, folder, "site_ref", "site", "tz_name", "date_order"), "site", "left")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value that fixes one instant to the minute or better, in UTC."""
    found = to_utc(_times(spark, folder), "value", "utc_offset", "tz_name", "site", "date_order")
    value = F.explode(F.when(F.col("utc_value").isNotNull(), F.array("utc_value")))  # a filter would be pushed below and repeat the whole parse
    return found.select("src", "id", "line_no", value.alias("utc_value")).distinct()


def p6_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """The same values where no source's order of numeric dates is known: what the mixtures settle by the sources' own values, and what stays open."""
    rows = _times(spark, folder).withColumn("date_order", F.lit(None).cast("string"))
    found = to_utc(rows, "value", "utc_offset", "tz_name", "site", "date_order")
    return found.select("src", "id", "line_no", "status", "utc_value").distinct()


def _gold(spark: SparkSession, folder: str, *columns: str | Column) -> DataFrame:
    """The latest row of each page. Of the ``columns`` (all if none are named) only what is asked for is read and moved."""
    gold = table(spark, folder, "mini_gold")
    gold = gold.select("id", "annotated_at", *columns) if columns else gold
    return scoring.latest(gold, "id", "annotated_at")


def _pred(spark: SparkSession, folder: str, *columns: str | Column) -> DataFrame:
    """The last line of each page, like :func:`_gold`."""
    pred = table(spark, folder, "mini_pred")
    return scoring.last_line(pred.select("id", "line_no", *columns) if columns else pred)


def _pairs(spark: SparkSession, folder: str, gold: list, pred: list) -> DataFrame:
    g, p = _gold(spark, folder, *gold).alias("g"), _pred(spark, folder, *pred).alias("p")
    return g.join(p, F.col("g.id") == F.col("p.id"), "left")


#: What a page is judged by, with a text cut to whether it is null, empty or neither, where nothing else of it matters.
def _hint(column: str) -> Column:
    return F.left(column, F.lit(1)).alias(column)


_FACTS = ["dataset", "site", "route", "content_structure", "page_condition"]
_TIMES = ["publish_time", "update_time"]


GOLD = "(SELECT * FROM mini_gold QUALIFY row_number() OVER (PARTITION BY id ORDER BY annotated_at DESC) = 1)"
PRED = "(SELECT * FROM mini_pred WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)"
PAIRS = f"{GOLD} g LEFT JOIN {PRED} p ON g.id = p.id"


def pred_last_wins(spark, folder):
    return _pred(spark, folder, "title").select("id", "line_no", "title")


def gold_left_join_pred(spark, folder):
    return _pairs(spark, folder, ["dataset"], [F.lit(1).alias("_")]).groupBy("g.dataset").agg(F.count("*").alias("pages"), F.count_if(F.col("p.id").isNull()).alias("missing")).select("dataset", "pages", "missing")


def rejection_accuracy(spark, folder):
    refused = F.col("p.id").isNull() | F.coalesce("p.rejected", F.lit(False))
    rows = _pairs(spark, folder, ["route", "content_structure", "page_condition"], ["rejected"]).select("g.route", should_reject(F.col("g.content_structure"), F.col("g.page_condition")).alias("refuse"), refused.alias("refused"))
    return rows.where("refuse").groupBy("route").agg(F.count("*").alias("pages"), F.round(F.avg(F.col("refused").cast("double")), 6).alias("accuracy"))


def time_scores(spark, folder):
    rows = _pairs(spark, folder, [F.col("publish_time.value").alias("t")], [F.col("publish_time.value").alias("t")]).where("g.t is not null")
    return rows.select("g.id", time_score(F.col("p.t"), F.col("g.t")).alias("score"))


def time_confusion(spark, folder):
    rows = _pairs(spark, folder, [F.col("update_time.value").alias("t")], [F.col("publish_time.value").alias("t")]).where("p.t is not null")
    return rows.select("g.id", time_confused(F.col("p.t"), F.col("g.t")).alias("confused"))


def zone_statuses(spark, folder):
    offset = F.col("publish_time.utc_offset").alias("o")
    return _pairs(spark, folder, ["site", offset], [offset]).groupBy("g.site", zone_status(F.col("p.o"), F.col("g.o")).alias("status")).agg(F.count("*").alias("pages")).select("site", "status", "pages")


def paragraph_ratios(spark, folder):
    count = paragraphs(F.col("content_text")).alias("n")
    a, b = F.coalesce("p.n", F.lit(0)), F.col("g.n")
    return _pairs(spark, folder, [count], [count]).select("g.id", F.round(smaller_share(a, b), 6).alias("ratio"))


def written_times(spark, folder):
    rows = table(spark, folder, "mini_pred", "line_no", "publish_time").where("publish_time.value is not null")
    return rows.select("line_no", written_time(F.col("publish_time.value")).alias("t")).select("line_no", "t.value", "t.utc_offset")


def field_tags(spark, folder):
    scores = scoring.score_pages(_gold(spark, folder, *_FACTS, _hint("title"), "authors", *_TIMES, _hint("content_text")), _pred(spark, folder, _hint("title"), "authors", *_TIMES, _hint("content_text"), "rejected"))
    tags = F.explode(F.array(*[F.struct(F.lit(c[:-4]).alias("field"), F.col(c).alias("tag")) for c in ("title_tag", "authors_tag", "content_text_tag", "publish_time_tag", "update_time_tag")]))
    return scores.where("not refuse").select(tags.alias("x")).groupBy("x.field", "x.tag").agg(F.count("*").alias("pages")).select("field", "tag", "pages")


def page_scores(spark, folder):
    return scoring.score_pages(_gold(spark, folder), _pred(spark, folder))


def score_report(spark, folder):
    return scoring.report(page_scores(spark, folder))


def report_grouping_sets(spark, folder):
    """The part of the report that needs no text normalisation."""
    scores = scoring.score_pages(_gold(spark, folder, *_FACTS, _hint("title"), "authors", *_TIMES, _hint("content_text")), _pred(spark, folder, _hint("title"), "authors", *_TIMES, _hint("content_text"), "rejected"))
    return scoring.report(scores).select("view", "value", "n_pages", "n_scored", *[F.round(c, 6).alias(c) for c in ("refusal_accuracy", "title_miss_rate", "authors_false_fill_rate", "content_text_miss_rate")])


def time_report(spark, folder):
    """Tags, zones and confusions of the publication time by view."""
    scores = scoring.score_pages(_gold(spark, folder, *_FACTS, _hint("title"), "authors", *_TIMES, _hint("content_text")), _pred(spark, folder, _hint("title"), "authors", *_TIMES, _hint("content_text"), "rejected"))
    return scoring.report(scores).select("view", "value", "publish_time_tags.*", "publish_time_zones.match", "publish_time_zones.mismatch", F.col("publish_time_zones.missing").alias("zone_missing"), "publish_time_zones.gold_absent", F.col("publish_time_confusions").alias("confused"), F.round("publish_time_score", 6).alias("score"))


def bad_refusals(spark, folder):
    """Pages that should have been refused and weren't, under each view."""
    facts = scoring.refusals(_gold(spark, folder, *_FACTS, _hint("title"), "authors", *_TIMES, _hint("content_text")), _pred(spark, folder, _hint("title"), "authors", *_TIMES, _hint("content_text"), "rejected"))
    return scoring.bad_refusals(facts)


def lax_scores(spark, folder):
    fields = ["title", "authors", "publish_time", "content_text"]
    return lenses.score_lax(_gold(spark, folder, *fields), _pred(spark, folder, *fields))


def lax_report(spark, folder):
    """The lax lens in five views."""
    fields = ["title", "authors", *_TIMES, "content_text"]
    return lenses.lax_report(_gold(spark, folder, *_FACTS, *fields), _pred(spark, folder, *fields, "rejected"))


def word_scores(spark, folder):
    fields = ["title", "authors", "publish_time", "content_text"]
    scores = lenses.score_words(_gold(spark, folder, *fields), _pred(spark, folder, *fields))
    return scores.select("id", *[F.round(c, 6).alias(c) for c in ("title", "authors", "content")])


def day_scores(spark, folder):
    """The part of the lax lens that SQL can say: whether both name the same day."""
    return lenses.score_days(_gold(spark, folder, "publish_time"), _pred(spark, folder, "publish_time")).where("publish is not null")


def refusal_shares(spark, folder):
    """Annotated conditions and structures by site, with the share to refuse."""
    rows = _gold(spark, folder, "site", "content_structure", "page_condition").select("site", should_reject(F.col("content_structure"), F.col("page_condition")).cast("double").alias("r"))
    return rows.groupBy("site").agg(F.count("*").alias("pages"), F.round(F.avg("r"), 6).alias("share"))


def unpredicted_pages(spark, folder):
    """Gold pages without a prediction, and predictions without a gold page."""
    gold, pred = table(spark, folder, "mini_gold", "id").distinct(), table(spark, folder, "mini_pred", "id").where("id is not null").distinct()
    missing, extra = gold.join(pred, "id", "left_anti"), pred.join(gold, "id", "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


def version_diff(spark, folder):
    """Pages whose publish score differs between the first and the last prediction line."""
    gold, lines = _gold(spark, folder, F.col("publish_time.value").alias("g")).where("g is not null"), table(spark, folder, "mini_pred").select("id", "line_no", F.col("publish_time.value").alias("p"))
    times = lambda pred: gold.join(pred, "id").select("id", time_score(F.col("p"), F.col("g")).alias("score"))
    first = scoring.newest(lines, "id", F.col("line_no").asc_nulls_last())
    return scoring.changed(times(first), times(scoring.last_line(lines)), "score").select("id", "before", "after", "change")


def gold_violations(spark, folder):
    return violations(table(spark, folder, "mini_gold")).groupBy("id", "rule").agg(F.count("*").alias("rows"))


def index_upsert(spark, folder):
    """The index after pages fetched again replace their earlier rows."""
    index = table(spark, folder, "spotcheck_index", "id", "fetched_at", "bytes")
    first = index.groupBy("id").agg(F.min_by(F.struct("fetched_at", "bytes"), F.struct("fetched_at", "bytes")).alias("r")).select("id", "r.*")
    again = index.join(first.select("id", F.col("fetched_at").alias("_f"), F.col("bytes").alias("_b")), "id").where("fetched_at > _f or bytes > _b").groupBy("id").agg(F.max(F.struct("fetched_at", "bytes")).alias("r")).select("id", "r.*")
    return upsert(first, again, ["id"])


def index_groups(spark, folder):
    rows = table(spark, folder, "spotcheck_index", "page_group", "site", "bytes", "fetched_at").where(F.col("page_group").isin("fixed", "generic"))
    return rows.groupBy("page_group", "site").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"), F.max("fetched_at").alias("last"))


def host_counts(spark, folder):
    host = F.parse_url("url", F.lit("HOST"))
    return table(spark, folder, "spotcheck_index", "url", "final_url").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_if(F.col("final_url").isNotNull() & (F.col("final_url") != F.col("url"))).alias("redirected"))


def first_pages_per_site(spark, folder):
    """The first two pages of each site by id."""
    ids = table(spark, folder, "mini_gold", "site", "id").where("site is not null").distinct()
    return ids.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("id"))).where("n <= 2").select("site", "id", "n")


def extraction_medians(spark, folder):
    rows = table(spark, folder, "dev5_validation", "id", "site", "trafilatura").select("id", "site", F.col("trafilatura.error").alias("error"), F.col("trafilatura.elapsed_ms_median").alias("ms"), "trafilatura").distinct().drop("trafilatura")
    counts = rows.groupBy("site").agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    middle = medians(rows, "site", "ms", "m").withColumnRenamed("site", "_site")
    return counts.join(middle, F.col("site").eqNullSafe(F.col("_site")), "left").select("site", "pages", "failed", F.round("m", 6).alias("median_ms"))


def refusal_sweep(spark, folder):
    """Articles and other pages that a minimum text length would refuse, by threshold."""
    limits = F.explode(F.array(*[F.lit(n) for n in (50, 100, 200, 400, 800)]))
    size = F.length(F.coalesce("content_text", F.lit(""))).alias("n")
    pages = _gold(spark, folder, "content_structure", "page_condition", size).select(should_reject(F.col("content_structure"), F.col("page_condition")).alias("refuse"), "n", limits.alias("threshold"))
    return pages.groupBy("threshold").agg(F.count_if(F.col("refuse") & (F.col("n") < F.col("threshold"))).alias("caught"), F.count_if(~F.col("refuse") & (F.col("n") < F.col("threshold"))).alias("wrongly"))


def structure_pivot(spark, folder):
    rows = _gold(spark, folder, "route", "content_structure").select("route", F.coalesce("content_structure", F.lit("none")).alias("structure"))
    return rows.groupBy("route").pivot("structure", ["single", "list_page", "photo_set", "live_blog", "none"]).count().na.fill(0)


def image_placeholders(spark, folder):
    count = F.regexp_count(F.coalesce("content_text", F.lit("")), F.lit("\\[\\[IMG_[0-9]+\\]\\]"))
    return _gold(spark, folder, "site", count.alias("n")).groupBy("site").agg(F.sum("n").cast("long").alias("images"), F.count_if(F.col("n") > 0).alias("pages"))


def event_props(spark, folder):
    """A number out of each event's JSON."""
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, folder, "events", "event_type", "props").groupBy("event_type").agg(F.count(value).alias("n"), F.sum(value).cast("long").alias("k"))


def markdown_tables(spark, folder):
    """Each region's nations as a Markdown table."""
    nations = table(spark, folder, "nation").select("n_regionkey", F.concat(F.lit("| "), F.col("n_nationkey"), F.lit(" | "), F.col("n_name"), F.lit(" |")).alias("line"), "n_nationkey")
    lines = nations.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "line"))).alias("l"))
    return lines.select(F.col("n_regionkey").alias("region"), F.concat(F.lit("| key | name |\n| --- | --- |\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))


def _tag_sql(field: str, empty: str, unknown: str = "") -> str:
    g, p = empty.format("g"), empty.format("p")
    return f"SELECT '{field}' AS field, CASE WHEN ({g}) AND ({p}) THEN 'correct_empty' WHEN ({g}) THEN 'false_fill' WHEN ({p}) THEN 'miss'{unknown} ELSE 'ok' END AS tag FROM j"


def _unknown_sql(x: str) -> str:
    """No part of a written time is without an X."""
    padded = f"rpad(coalesce({x}, ''), 19, 'X')"
    return " AND ".join(f"contains(substring({padded}, {a}, {n}), 'X')" for a, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)))


_TAGS = " UNION ALL ".join(
    (
        _tag_sql("title", "coalesce({}_title, '') = ''"),
        _tag_sql("authors", "coalesce(len({}_authors), 0) = 0"),
        _tag_sql("content_text", "coalesce({}_text, '') = ''"),
        _tag_sql("publish_time", "coalesce({}_pt, '') = ''", f" WHEN {_unknown_sql('g_pt')} THEN 'gold_all_xx'"),
        _tag_sql("update_time", "coalesce({}_ut, '') = ''", f" WHEN {_unknown_sql('g_ut')} THEN 'gold_all_xx'"),
    )
)
_REJECT = "(g.content_structure IS DISTINCT FROM 'single' OR coalesce(g.page_condition, 'ok') <> 'ok')"
_J = f"""j AS (SELECT g.id, g.dataset, g.site, g.route, g.content_structure, {_REJECT} AS refuse, p.id IS NULL OR coalesce(p.rejected, false) AS refused_flag, g.title AS g_title, p.title AS p_title, g.authors AS g_authors, p.authors AS p_authors,
 g.content_text AS g_text, p.content_text AS p_text, g.publish_time.value AS g_pt, p.publish_time.value AS p_pt, g.update_time.value AS g_ut, p.update_time.value AS p_ut, p.publish_time AS p_ps, p.update_time AS p_us, g.publish_time.utc_offset AS g_po, p.publish_time.utc_offset AS p_po FROM {PAIRS})"""


def _pad(x: str) -> str:
    return f"rpad(coalesce({x}, ''), 19, 'X')"


def _time_sql(p: str, g: str) -> str:
    parts = ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))
    known = [f"NOT contains(substring({_pad(g)}, {a}, {n}), 'X')" for a, n in parts]
    agree = [f"(NOT ({k}) OR substring({_pad(p)}, {a}, {n}) = substring({_pad(g)}, {a}, {n}))" for k, (a, n) in zip(known, parts)]
    return f"CASE WHEN {p} IS NULL THEN 0.0::DOUBLE WHEN NOT ({' OR '.join(known)}) THEN NULL WHEN {' AND '.join(agree)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


_SPACE = "[\\t\\n\\v\\f\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _paragraphs_sql(x: str) -> str:
    return f"len(list_filter(string_split(coalesce({x}, ''), chr(10)), lambda l: regexp_replace(l, '{_SPACE}', '', 'g') <> ''))"


def _part(pattern: str, g: int, x: str = "publish_time.value") -> str:
    v = f"regexp_extract(trim({x}), '{pattern}', {g})"
    return f"CASE WHEN {v} = '' THEN 'XX' ELSE lpad({v}, 2, '0') END"


def _value_sql(pattern: str) -> str:
    return f"regexp_extract(trim(publish_time.value), '{pattern}', 1) || '-' || {_part(pattern, 2)} || '-' || {_part(pattern, 3)} || ' ' || {_part(pattern, 4)} || ':' || {_part(pattern, 5)} || ':' || {_part(pattern, 6)}"


_N = "([0-9]{1,2})"
_ISO = f"^([0-9]{{4}})-{_N}-{_N}(?:[T ]{_N}:{_N}(?::{_N}(?:\\.[0-9]+)?)?)?[ \\t\\n]*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?$"
_HYPHEN = f"^([0-9]{{4}})-{_N}-{_N}-{_N}:{_N}(?::{_N})?$"
_B = "[ \\t\\n　\\x{a0}]*"
_CHINESE = f"([0-9]{{4}}){_B}年{_B}{_N}{_B}月{_B}{_N}{_B}日{_B}(?:{_N}{_B}[:：]{_B}{_N}(?:{_B}[:：]{_B}{_N})?)?"
_ZONE = f"regexp_extract(trim(publish_time.value), '{_ISO}', 7)"
_TIME_FORM = "^[0-9]{4}-([0-9]{2}|XX)-([0-9]{2}|XX) ([0-9]{2}|XX):([0-9]{2}|XX):([0-9]{2}|XX)$"
_PT, _UT = "publish_time.value", "update_time.value"
_IMAGES = "regexp_extract_all(content_text, '\\[\\[IMG_[0-9]+\\]\\]')"
_RULES = {
    "structure_unknown": "NOT coalesce(content_structure IN ('single','multi','list_page','photo_set'), false)",
    "condition_unknown": "NOT coalesce(page_condition IN ('ok','empty_shell','anti_bot_suspected','truncated','dns_fail','http_403'), false)",
    "title_missing": "content_structure = 'single' AND coalesce(title, '') = ''",
    "publish_form": f"{_PT} IS NOT NULL AND NOT regexp_matches({_PT}, '{_TIME_FORM}')",
    "update_form": f"{_UT} IS NOT NULL AND NOT regexp_matches({_UT}, '{_TIME_FORM}')",
    "publish_offset_form": "publish_time.utc_offset IS NOT NULL AND NOT regexp_matches(publish_time.utc_offset, '^[+-][0-9]{2}:[0-9]{2}$')",
    "update_before_publish": f"regexp_matches({_PT}, '{_TIME_FORM}') AND regexp_matches({_UT}, '{_TIME_FORM}') AND NOT contains({_PT}, 'X') AND NOT contains({_UT}, 'X') AND {_UT} < {_PT}",
    "refusal_filled": "expect_refusal AND coalesce(content_text, '') <> ''",
    "image_twice": f"len(list_distinct({_IMAGES})) < len({_IMAGES})",
}
_RATE = "CASE WHEN count(*) FILTER (NOT refuse AND {g}) = 0 THEN NULL ELSE round(count(*) FILTER (NOT refuse AND {g} AND {p})::DOUBLE / count(*) FILTER (NOT refuse AND {g}), 6) END"
_EMPTY_RECORD = "refused_flag OR (coalesce(p_title, '') = '' AND coalesce(len(p_authors), 0) = 0 AND coalesce(p_text, '') = '' AND p_ps IS NULL AND p_us IS NULL)"
_VIEWS = " UNION ALL ".join(
    f"""SELECT '{v}' AS view, {x} AS value, count(*) AS n_pages, count(*) FILTER (NOT refuse) AS n_scored, round(avg(CASE WHEN refuse THEN CASE WHEN {_EMPTY_RECORD} THEN 1.0 ELSE 0.0 END END), 6) AS refusal_accuracy,
 {_RATE.format(g="coalesce(g_title, '') <> ''", p="coalesce(p_title, '') = ''")} AS title_miss_rate, {_RATE.format(g='coalesce(len(g_authors), 0) = 0', p='coalesce(len(p_authors), 0) > 0')} AS authors_false_fill_rate,
 {_RATE.format(g="coalesce(g_text, '') <> ''", p="coalesce(p_text, '') = ''")} AS content_text_miss_rate FROM j{g}"""
    for v, x, g in [("overall", "'all'", ""), *[(v, f"coalesce({v}, 'unknown')", f" GROUP BY {v}") for v in scoring.VIEWS]]
)
_REFUSED = f"({_EMPTY_RECORD})"
_TIME_J = f"""t AS (SELECT *, CASE WHEN NOT refuse THEN CASE WHEN coalesce(g_pt, '') = '' AND coalesce(p_pt, '') = '' THEN 'correct_empty' WHEN coalesce(g_pt, '') = '' THEN 'false_fill' WHEN coalesce(p_pt, '') = '' THEN 'miss' WHEN {_unknown_sql('g_pt')} THEN 'gold_all_xx' ELSE 'ok' END END AS tag FROM j),
 u AS (SELECT *, CASE WHEN tag IN ('miss', 'ok') THEN CASE WHEN g_po IS NULL THEN 'gold_absent' WHEN p_po IS NULL THEN 'missing' WHEN g_po = p_po THEN 'match' ELSE 'mismatch' END END AS zone,
 CASE WHEN tag = 'ok' THEN {_time_sql('p_pt', 'g_pt')} WHEN tag IN ('miss', 'false_fill') THEN 0.0::DOUBLE END AS s, tag = 'ok' AND g_ut <> '' AND ({_pad('p_pt')} = {_pad('g_ut')} OR starts_with({_pad('p_pt')}, rtrim(g_ut, 'X'))) AS mixed FROM t)"""
_TIME_VIEWS = " UNION ALL ".join(
    f"SELECT '{v}' AS view, {x} AS value, " + ", ".join(f"count(*) FILTER (tag = '{t}') AS {t}" for t in scoring.TAGS) + ", " + ", ".join(f"count(*) FILTER (zone = '{z}') AS {n}" for z, n in (("match", "match"), ("mismatch", "mismatch"), ("missing", "zone_missing"), ("gold_absent", "gold_absent"))) + f", count(*) FILTER (mixed) AS confused, round(avg(s), 6) AS score FROM u{g}"
    for v, x, g in [("overall", "'all'", ""), *[(v, f"coalesce({v}, 'unknown')", f" GROUP BY {v}") for v in scoring.VIEWS]]
)
_BAD_VIEWS = " UNION ALL ".join(f"SELECT '{v}' AS view, {x} AS value, id FROM j WHERE refuse AND NOT {_REFUSED}" for v, x in [("overall", "'all'"), *[(v, f"coalesce({v}, 'unknown')") for v in scoring.VIEWS]])
_PUBLISH = "g.publish_time.value"
_FIRST = "(SELECT id, min(struct_pack(f := fetched_at, b := bytes)) AS r FROM spotcheck_index GROUP BY id)"

def _runs_sql(x: str) -> str:
    """Runs of four words of a text, or all of a shorter one, as a list of strings."""
    words = f"list_filter(string_split_regex(coalesce({x}, ''), '{_SPACE}+'), lambda w: w <> '')"
    return f"(SELECT CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, chr(31))] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], chr(31))) END FROM (SELECT {words} AS w))"


def _bag_f1_sql(a: str, b: str) -> str:
    """F1 of two bags of strings."""
    common = f"list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda h: h = g)), len(list_filter({b}, lambda h: h = g)))))"
    return f"CASE WHEN coalesce({common}, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0 * {common} / (len({a}) + len({b})) END"


def _names_sql(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(coalesce({x}.authors, []), lambda x: regexp_replace(lower(x), '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> ''))"


_WORDS = f"""WITH t AS (SELECT g.id, g.title AS gt, g.content_text AS gc, {_names_sql('g')} AS ga, {_names_sql('p')} AS pa, {_runs_sql('p.title')} AS ptr, {_runs_sql('g.title')} AS gtr, {_runs_sql('p.content_text')} AS pcr, {_runs_sql('g.content_text')} AS gcr FROM {PAIRS}),
 grams AS (SELECT id, r, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'g') AS g FROM (SELECT id, 'p' AS side, unnest(pcr) AS r FROM t UNION ALL SELECT id, 'g', unnest(gcr) FROM t) GROUP BY id, r),
 common AS (SELECT id, sum(least(p, g))::DOUBLE AS c FROM grams GROUP BY id)
 SELECT t.id, CASE WHEN coalesce(gt, '') <> '' THEN {_bag_f1_sql('ptr', 'gtr')} END AS title, CASE WHEN len(ga) > 0 THEN CASE WHEN len(list_intersect(pa, ga)) = 0 THEN 0.0::DOUBLE ELSE 2.0 * len(list_intersect(pa, ga)) / (len(pa) + len(ga)) END END AS authors,
 CASE WHEN coalesce(gc, '') <> '' THEN CASE WHEN coalesce(c, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0 * c / (len(pcr) + len(gcr)) END END AS content FROM t LEFT JOIN common ON t.id = common.id"""

ORACLES: dict[str, str] = {
    "word_scores": f"SELECT id, round(title, 6) AS title, round(authors, 6) AS authors, round(content, 6) AS content FROM ({_WORDS})",
    "pred_last_wins": f"SELECT id, line_no, title FROM {PRED}",
    "gold_left_join_pred": f"SELECT g.dataset, count(*) AS pages, count(*) FILTER (p.id IS NULL) AS missing FROM {PAIRS} GROUP BY g.dataset",
    "rejection_accuracy": f"SELECT g.route, count(*) AS pages, round(avg(CASE WHEN p.id IS NULL OR coalesce(p.rejected, false) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {PAIRS} WHERE {_REJECT} GROUP BY g.route",
    "time_scores": f"SELECT g.id, {_time_sql('p.publish_time.value', _PUBLISH)} AS score FROM {PAIRS} WHERE {_PUBLISH} IS NOT NULL",
    "time_confusion": f"SELECT g.id, coalesce(p.publish_time.value <> '' AND g.update_time.value <> '' AND ({_pad('p.publish_time.value')} = {_pad('g.update_time.value')} OR starts_with({_pad('p.publish_time.value')}, rtrim(g.update_time.value, 'X'))), false) AS confused FROM {PAIRS} WHERE p.publish_time.value IS NOT NULL",
    "zone_statuses": f"SELECT g.site, CASE WHEN g.publish_time.utc_offset IS NULL THEN 'gold_absent' WHEN p.publish_time.utc_offset IS NULL THEN 'missing' WHEN g.publish_time.utc_offset = p.publish_time.utc_offset THEN 'match' ELSE 'mismatch' END AS status, count(*) AS pages FROM {PAIRS} GROUP BY ALL",
    "paragraph_ratios": f"SELECT id, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a = 0 OR b = 0 THEN 0.0::DOUBLE ELSE round(least(a, b)::DOUBLE / greatest(a, b), 6) END AS ratio FROM (SELECT g.id, {_paragraphs_sql('p.content_text')} AS a, {_paragraphs_sql('g.content_text')} AS b FROM {PAIRS})",
    "written_times": f"SELECT line_no, CASE WHEN regexp_matches(trim({_PT}), '{_ISO}') THEN {_value_sql(_ISO)} WHEN regexp_matches(trim({_PT}), '{_HYPHEN}') THEN {_value_sql(_HYPHEN)} WHEN regexp_matches(trim({_PT}), '{_CHINESE}') THEN {_value_sql(_CHINESE)} END AS value, CASE WHEN NOT regexp_matches(trim({_PT}), '{_ISO}') OR {_ZONE} = '' THEN NULL WHEN {_ZONE} = 'Z' THEN '+00:00' ELSE substring({_ZONE}, 1, 3) || ':' || right({_ZONE}, 2) END AS utc_offset FROM mini_pred WHERE {_PT} IS NOT NULL",
    "field_tags": f"WITH {_J.replace('FROM ' + PAIRS, 'FROM ' + PAIRS + ' WHERE NOT ' + _REJECT)} SELECT field, tag, count(*) AS pages FROM ({_TAGS}) GROUP BY ALL",
    "report_grouping_sets": f"WITH {_J} {_VIEWS}",
    "time_report": f"WITH {_J}, {_TIME_J} {_TIME_VIEWS}",
    "bad_refusals": f"WITH {_J} {_BAD_VIEWS}",
    "day_scores": f"SELECT g.id, (substring(p.publish_time.value, 1, 10) = substring({_PUBLISH}, 1, 10))::INT::DOUBLE AS publish FROM {PAIRS} WHERE length({_PUBLISH}) >= 10 AND length(p.publish_time.value) >= 10 AND NOT contains(substring({_PUBLISH}, 1, 10), 'X') AND NOT contains(substring(p.publish_time.value, 1, 10), 'X')",
    "refusal_shares": f"SELECT site, count(*) AS pages, round(avg(({_REJECT})::INT::DOUBLE), 6) AS share FROM {GOLD} g GROUP BY site",
    "unpredicted_pages": "(SELECT id, 'missing' AS side FROM mini_gold EXCEPT SELECT id, 'missing' FROM mini_pred) UNION ALL (SELECT id, 'extra' FROM mini_pred WHERE id IS NOT NULL EXCEPT SELECT id, 'extra' FROM mini_gold)",
    "version_diff": f"""WITH a AS (SELECT g.id, {_time_sql('p.publish_time.value', _PUBLISH)} AS s FROM {GOLD} g JOIN (SELECT * FROM mini_pred QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) = 1) p ON g.id = p.id WHERE {_PUBLISH} IS NOT NULL),
 b AS (SELECT g.id, {_time_sql('p.publish_time.value', _PUBLISH)} AS s FROM {GOLD} g JOIN {PRED} p ON g.id = p.id WHERE {_PUBLISH} IS NOT NULL)
 SELECT a.id, a.s AS before, b.s AS after, coalesce(b.s, 0) - coalesce(a.s, 0) AS change FROM a JOIN b ON a.id = b.id WHERE a.s IS DISTINCT FROM b.s""",
    "gold_violations": "SELECT id, rule, count(*) AS rows FROM (" + " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM mini_gold WHERE {c}" for n, c in _RULES.items()) + " UNION ALL SELECT id, 'id_twice' FROM mini_gold GROUP BY id HAVING count(*) > 1) GROUP BY id, rule",
    "index_upsert": f"WITH f AS {_FIRST}, n AS (SELECT s.id, max(struct_pack(f := s.fetched_at, b := s.bytes)) AS r FROM spotcheck_index s JOIN f ON s.id = f.id WHERE s.fetched_at > f.r.f OR s.bytes > f.r.b GROUP BY s.id) SELECT f.id, coalesce(n.r, f.r).f AS fetched_at, coalesce(n.r, f.r).b AS bytes FROM f LEFT JOIN n ON f.id = n.id",
    "index_groups": "SELECT page_group, site, count(*) AS pages, sum(bytes)::BIGINT AS bytes, max(fetched_at) AS last FROM spotcheck_index WHERE page_group IN ('fixed', 'generic') GROUP BY ALL",
    "host_counts": "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, count(*) FILTER (final_url IS NOT NULL AND final_url <> url) AS redirected FROM spotcheck_index GROUP BY 1",
    "first_pages_per_site": "SELECT site, id, n::INT AS n FROM (SELECT site, id, row_number() OVER (PARTITION BY site ORDER BY id) AS n FROM (SELECT DISTINCT site, id FROM mini_gold WHERE site IS NOT NULL)) WHERE n <= 2",
    "extraction_medians": "SELECT site, count(*) AS pages, count(*) FILTER (trafilatura.error IS NOT NULL) AS failed, round(median(trafilatura.elapsed_ms_median), 6) AS median_ms FROM (SELECT DISTINCT id, site, trafilatura FROM dev5_validation) GROUP BY site",
    "refusal_sweep": f"SELECT t::INT AS threshold, count(*) FILTER (refuse AND n < t) AS caught, count(*) FILTER (NOT refuse AND n < t) AS wrongly FROM (SELECT {_REJECT} AS refuse, length(coalesce(content_text, '')) AS n, unnest([50, 100, 200, 400, 800]) AS t FROM {GOLD} g) GROUP BY t",
    "structure_pivot": "SELECT route, " + ", ".join(f"count(*) FILTER (coalesce(content_structure, 'none') = '{x}') AS {x}" for x in ("single", "list_page", "photo_set", "live_blog", "none")) + f" FROM {GOLD} GROUP BY route",
    "image_placeholders": f"SELECT site, sum(len({_IMAGES.replace('content_text', 'coalesce(content_text, chr(32))')}))::BIGINT AS images, count(*) FILTER (len({_IMAGES.replace('content_text', 'coalesce(content_text, chr(32))')}) > 0) AS pages FROM {GOLD} GROUP BY site",
    "event_props": "SELECT event_type, count(json_extract(props, '$.k')) AS n, sum(json_extract(props, '$.k')::INT)::BIGINT AS k FROM events GROUP BY event_type",
    "markdown_tables": "SELECT n_regionkey AS region, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey",
}

QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p6_found, p6_inferred, pred_last_wins, gold_left_join_pred, rejection_accuracy, time_scores, time_confusion, zone_statuses, paragraph_ratios, written_times, field_tags, page_scores, score_report, report_grouping_sets, time_report, bad_refusals, lax_scores, lax_report, word_scores, day_scores, refusal_shares, unpredicted_pages,
        version_diff, gold_violations, index_upsert, index_groups, host_counts, first_pages_per_site, extraction_medians, refusal_sweep, structure_pivot, image_placeholders, event_props, markdown_tables,
    )
}
