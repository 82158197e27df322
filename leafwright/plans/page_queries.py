"""Queries of page extraction. The pages are written from the tables' records, so what must come out of them is known.

Each record becomes an HTML page: its title, authors and times in meta tags, its lines as paragraphs, links or pictures of an article
between a menu and a footer. The SQL works out what extraction must find from the records alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.functions.columns import spoken_time, stripped
from leafwright.operators.calibrate import measured, outcome
from leafwright.pages import names, titles
from leafwright.pages import record as pages_to_records
from leafwright.plans.core_queries import _SPACE
from leafwright.sources.index import describe, links
from leafwright.sources.tables import table

MENU = '<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/world">World</a></li><li><a href="/sport#top">Sport</a></li></ul></nav>'
FOOTER = "<footer><p>Terms of use and other legal lines of the publisher, which every page of a site ends with and which no record ever holds. They are long enough that no page is taken for an empty shell, whatever its record has. All rights reserved.</p></footer>"


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: stripped(x) != "")


def page(title: Column, authors: Column, publish: Column, update: Column, article: Column, footer: str = FOOTER) -> Column:
    """Bytes of a page. A null part is left out."""
    tag = lambda kind, name, value: F.when(value.isNotNull(), F.concat(F.lit(f'<meta {kind}="{name}" content="'), escaped(value), F.lit('">'))).otherwise("")
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escaped(title), F.lit("</title>"), tag("property", "og:title", title), tag("name", "author", authors), tag("property", "article:published_time", publish), tag("property", "article:modified_time", update))
    return F.encode(F.concat(head, F.lit(f"</head><body>{MENU}<article>"), article, F.lit(f"</article>{footer}</body></html>")), "UTF-8")


def paragraphs_of(text: Column) -> Column:
    return F.array_join(F.transform(_lines(text), lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))), "\n")


def _site(page_id: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(page_id, "^(.*)__", 1), "_", "")


def _predicted(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """(id, site, raw): a page for each prediction line that has an id; only the named fields are read and written."""
    rows = table(spark, folder, "mini_pred", "line_no", "id", *columns).where("id is not null")
    none = F.lit(None).cast("string")
    has = lambda c, x: F.expr(x) if c in columns else none
    article = paragraphs_of(F.col("content_text")) if "content_text" in columns else F.lit("<p>A line.</p>")
    raw = page(has("title", "title"), has("authors", "array_join(authors, '; ')"), has("publish_time", "publish_time.value"), has("update_time", "update_time.value"), article)
    return rows.select(F.col("line_no").cast("string").alias("id"), _site(F.col("id")).alias("site"), raw.alias("raw"))


def _number(records: DataFrame) -> Column:
    return records["id"].cast("long").alias("line_no")


def extracted_titles(spark, folder):
    """Titles of pages whose meta tags have the predicted ones."""
    got = pages_to_records.extract(_predicted(spark, folder, "title"))
    return got.select(_number(got), "title")


def extracted_times(spark, folder):
    """Publication and update times of pages, as far as their meta tags have a form that is read."""
    got = pages_to_records.extract(_predicted(spark, folder, "publish_time", "update_time"))
    return got.select(_number(got), F.col("publish_time.value").alias("publish"), F.col("publish_time.utc_offset").alias("publish_offset"), F.col("update_time.value").alias("update"))


def extracted_texts(spark, folder):
    """The article of each page, without menu and footer; its lines with single blanks."""
    got = pages_to_records.extract(_predicted(spark, folder, "content_text"))
    return got.select(_number(got), "content_text")


def extracted_authors(spark, folder):
    """Authors of pages, from meta tags and, where these have none, from bylines in the article."""
    got = pages_to_records.extract(_predicted(spark, folder, "authors", "content_text"))
    return got.select(_number(got), F.array_join("authors", "; ").alias("authors"), F.try_element_at("provenance", F.lit("authors")).alias("origin"))


def pages_of_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(id, site, raw): a whole page for each prediction line."""
    return _predicted(spark, folder, "title", "authors", "publish_time", "update_time", "content_text")


def extract_records(spark, folder):
    """Whole records of whole pages."""
    return pages_to_records.extract(pages_of_predictions(spark, folder))


def _laid_out(spark: SparkSession, folder: str) -> DataFrame:
    """(id, raw, expect_refusal): gold pages laid out by their structure: lines of lists as links, those of photo sets as captions of pictures, others as paragraphs."""
    gold = table(spark, folder, "mini_gold", "id", "content_structure", "content_text").distinct()
    lines = _lines(F.col("content_text"))
    linked = F.array_join(F.transform(lines, lambda x: F.concat(F.lit('<li><a href="/x">'), escaped(x), F.lit("</a></li>"))), "")
    shown = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit('<figure><img src="/p'), i, F.lit('.jpg"><figcaption>'), escaped(x), F.lit("</figcaption></figure>"))), "")
    structure = F.coalesce("content_structure", F.lit("none"))
    article = F.when(structure == "list_page", linked).when(structure == "photo_set", shown).otherwise(paragraphs_of(F.col("content_text")))
    none = F.lit(None).cast("string")
    return gold.select("id", structure.alias("structure"), F.lit(None).cast("string").alias("site"), structure.isin("list_page", "photo_set").alias("expect_refusal"), page(none, none, none, none, article, "").alias("raw"))


def refused_pages(spark, folder):
    """Why pages are refused, by how they are laid out."""
    rows = _laid_out(spark, folder)
    found = pages_to_records.extract(rows).select("id", F.coalesce(F.regexp_extract("route", "^refused:(.*)$", 1), F.lit("")).alias("reason"))
    return found.join(rows.select(F.col("id").alias("_id"), "structure"), F.col("id") == F.col("_id")).groupBy("structure", "reason").agg(F.count("*").alias("pages"))


def refusal_calibration(spark, folder):
    """False and missed refusals of pages and of galleries put in place of their articles, by the least number of pictures of a set."""
    sizes = F.explode(F.array(*[F.lit(n) for n in (6, 8, 10, 12)]))
    rows = measured(_laid_out(spark, folder)).select("*", sizes.alias("set_images"))
    return outcome(rows, {"set_images": F.col("set_images"), "set_captions": F.col("set_images")}, "set_images")


def page_facts(spark, folder):
    """Bytes, hash and declared encoding of pages."""
    rows = _predicted(spark, folder, "title")
    return rows.select(F.col("id").cast("long").alias("line_no"), *describe(F.col("raw")))


def site_links(spark, folder):
    """The links of each site's pages, absolute and without fragment, each once a site."""
    rows = _predicted(spark, folder, "title").select("*", F.concat(F.lit("https://"), "site", F.lit(".example/news/")).alias("url"))
    return links(rows, "example/").select("site", "url")


def plain_titles(spark, folder):
    """Predicted titles without the brand at their end."""
    rows = table(spark, folder, "mini_pred", "line_no", "id", "title").where("title is not null")
    return rows.select("line_no", titles.without_brand(F.col("title"), _site(F.col("id"))).alias("title"))


def credible_authors(spark, folder):
    """Predicted authors that no media name, number or other non-person is."""
    fit = F.filter(F.transform("authors", names.clean), lambda n: n.isNotNull() & names.category(n).isNull())
    return table(spark, folder, "mini_pred", "line_no", "authors").select("line_no", F.array_join(fit, "; ").alias("authors"))


def spoken_times(spark, folder):
    """Predicted update times in the forms people write: ISO, Chinese, dotted and with English months."""
    rows = table(spark, folder, "mini_pred", "line_no", "update_time").where("update_time.value is not null")
    return rows.select("line_no", spoken_time(F.col("update_time.value")).alias("t")).select("line_no", F.col("t.value").alias("value"))


# --- the same in SQL
def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


_SITE_SQL = "replace(regexp_extract(coalesce(id, ''), '^(.*)__', 1), '_', '')"
_WORDS_SQL = "', '".join(titles.BRAND_WORDS)


def _brand_sql(x: str) -> str:
    """``x`` is a stripped segment; ``stems`` is a column."""
    word = f"list_has_any(regexp_extract_all(lower({x}), '[a-z]+'), ['{_WORDS_SQL}'])"
    brands = "', '".join(titles.BRANDS)
    form = _re(titles.BRAND_FORM)
    return (
        f"({x} = '' OR {x} IN ('{brands}') OR regexp_matches({x}, '{form}') OR regexp_matches({x}, '{titles.SHORT_BRAND}') OR regexp_matches(lower({x}), '{titles.SITE_WORDS}')"
        f" OR (length({x}) <= 60 AND len(list_filter(stems, lambda q: contains(regexp_replace(lower({x}), '[^a-z0-9]', '', 'g'), q))) > 0) OR (length({x}) <= 40 AND {word}))"
    )


def _kept_sql(flags: str, least: str) -> str:
    return f"least(greatest(coalesce(list_max(list_transform({flags}, lambda f, i: CASE WHEN f THEN 0 ELSE i END)), 0), {least}), len({flags}))"


def _title_sql(source: str, keys: str) -> str:
    """Statements that add ``title`` to ``keys``, id and title of ``source``."""
    channel = f"(p <> '' AND length(p) <= 10 AND NOT regexp_matches(p, '{titles.SENTENCE_MARKS}') AND regexp_matches(p, '{titles.CHANNEL}'))"
    separator = titles.SEPARATOR
    return f"""
 a AS (SELECT {keys}, {_squeeze_sql('title')} AS t, list_filter([regexp_replace(lower(string_split({_SITE_SQL}, '.')[1]), '[^a-z0-9]', '', 'g'), regexp_replace(lower({_SITE_SQL}), '[^a-z0-9]', '', 'g')], lambda q: length(q) >= 4) AS stems FROM {source}),
 b AS (SELECT *, string_split(t, '--') AS parts, list_transform(string_split(t, '--'), lambda s: {_strip_sql('s')}) AS bare FROM a),
 c AS (SELECT {keys}, stems, t, parts, list_transform(bare, lambda p: {_brand_sql('p')} OR {channel}) AS flags, CASE WHEN bare[1] = '' THEN 2 ELSE 1 END AS least_kept FROM b),
 d AS (SELECT {keys}, stems, CASE WHEN contains(t, '--') THEN {_strip_sql("array_to_string(parts[1:" + _kept_sql('flags', 'least_kept') + "], '--')")} ELSE t END AS t FROM c),
 e AS (SELECT *, string_split_regex(t, '{separator}') AS parts, regexp_extract_all(t, '{separator}') AS marks FROM d),
 f AS (SELECT *, {_kept_sql('list_transform(parts, lambda p: ' + _brand_sql(_strip_sql('p')) + ')', 'coalesce(list_min(list_transform(parts, lambda p, i: CASE WHEN p <> chr(0) AND p <> ' + "''" + ' THEN i ELSE len(parts) END)), 1)')} AS n FROM e),
 titled AS (SELECT {keys}, CASE WHEN regexp_matches(t, '{separator}') THEN {_strip_sql("array_to_string(list_transform(parts[1:n], lambda p, i: p || CASE WHEN i < n THEN marks[i] ELSE '' END), '')")} ELSE t END AS title FROM f)"""


def _person_sql(x: str) -> str:
    """Null or the cleaned name."""
    bare = f"regexp_replace({_squeeze_sql(x)}, '^[ ，,、。:：|｜]+|[ ，,、。:：|｜]+$', '', 'g')"
    none = "|".join(names.NO_AUTHOR)
    return f"CASE WHEN length({bare}) <= 20 AND NOT regexp_matches({bare}, '(?i)^(?:{none}|[0-9]+)?$') AND NOT (length({bare}) >= 4 AND regexp_matches({bare}, '{names.MEDIA}')) AND regexp_matches({bare}, '{_re(names.PERSON)}') THEN {bare} END"


def _category_sql(x: str) -> str:
    words = f"regexp_extract_all(lower({x}), '[a-z]+')"
    among = lambda table: "list_has_any(" + words + ", ['" + "', '".join(table) + "'])"
    days = f"(len({words}) > 0 AND len(list_filter({words}, lambda w: w NOT IN ('" + "', '".join(names.CALENDAR) + "'))) = 0)"
    return f"(regexp_matches({x}, '^[A-Za-z0-9 .,''&-]+$') AND ({among(names.SOCIAL)} OR {days} OR {among(names.BODY_OR_ROLE)}))"


_LINE_SQL = f"list_filter(list_transform(string_split(coalesce(content_text, ''), chr(10)), lambda l: {_squeeze_sql('l')}), lambda l: l <> '')"
_LENGTHS = "list_sum(list_transform(ls, lambda l: length(l)))"


def oracles() -> dict[str, str]:
    from leafwright.plans import core_queries as core

    time = lambda x: f"CASE WHEN regexp_matches(trim({x}), '{core._ISO}') THEN {core._value_sql(core._ISO)} WHEN regexp_matches(trim({x}), '{core._HYPHEN}') THEN {core._value_sql(core._HYPHEN)} WHEN regexp_matches(trim({x}), '{core._CHINESE}') THEN {core._value_sql(core._CHINESE)} END".replace("publish_time.value", x)
    offset = f"CASE WHEN NOT regexp_matches(trim(publish_time.value), '{core._ISO}') OR {core._ZONE} = '' THEN NULL WHEN {core._ZONE} = 'Z' THEN '+00:00' ELSE substring({core._ZONE}, 1, 3) || ':' || right({core._ZONE}, 2) END"
    month = "|".join(x for x in ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sep(?:t(?:ember)?)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?"))
    named = f"(?i)(?:([0-9]{{1,2}})(?:st|nd|rd|th)?\\s+)?({month})\\.?\\s*(?:([0-9]{{1,2}})(?:st|nd|rd|th|\\s|,))?,?\\s*([0-9]{{4}})(?:[\\s/|–-]+([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?(?:\\s*([ap]m)\\.?)?)?"
    dotted = "\\b([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})(?:\\s+([0-9]{1,2}):([0-9]{2}))?"
    u = "trim(update_time.value)"
    g = lambda p, i: f"regexp_extract({u}, '{p}', {i})"
    two = lambda x: f"CASE WHEN {x} = '' THEN 'XX' ELSE lpad({x}, 2, '0') END"
    day = f"CASE WHEN {g(named, 1)} <> '' THEN {g(named, 1)} ELSE {g(named, 3)} END"
    hour = f"CASE WHEN {g(named, 5)} = '' THEN '' WHEN {g(named, 8)} = '' THEN {g(named, 5)} ELSE (({g(named, 5)}::INT) % 12 + CASE WHEN lower({g(named, 8)}) = 'pm' THEN 12 ELSE 0 END)::VARCHAR END"
    months = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
    by_number = f"{g(dotted, 3)} || '-' || {two(g(dotted, 2))} || '-' || {two(g(dotted, 1))} || ' ' || {two(g(dotted, 4))} || ':' || {two(g(dotted, 5))} || ':' || CASE WHEN {g(dotted, 4)} = '' THEN 'XX' ELSE '00' END"
    by_name = f"{g(named, 4)} || '-' || lpad(list_position({months}, lower(left({g(named, 2)}, 3)))::VARCHAR, 2, '0') || '-' || lpad({day}, 2, '0') || ' ' || {two(hour)} || ':' || {two(g(named, 6))} || ':' || CASE WHEN {g(named, 5)} = '' THEN 'XX' WHEN {g(named, 7)} = '' THEN '00' ELSE {g(named, 7)} END"
    html = "'<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>' || {e} || '</title>' || CASE WHEN title IS NULL THEN '' ELSE '<meta property=\"og:title\" content=\"' || {e} || '\">' END || '</head><body>{m}<article><p>A line.</p></article>{f}</body></html>'"
    escape = "replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    html = html.format(e=escape, m=MENU, f=FOOTER)
    menu = len("HomeWorldSport")
    n = "coalesce(list_sum(list_transform(ls, lambda l: length(l))), 0)"
    long_links = "list_filter(ls, lambda l: length(l) >= 12)"
    n_long = f"coalesce(list_sum(list_transform({long_links}, lambda l: length(l))), 0)"
    captioned = f"len(ls) >= 8 AND {n}::DOUBLE / len(ls) < 120 OR len(ls) >= 6 AND {n}::DOUBLE / len(ls) < 150"
    reason = f"""CASE WHEN s = 'list_page' THEN CASE WHEN len({long_links}) >= 30 AND {n_long}::DOUBLE / ({n} + {menu}) >= 0.55 THEN 'list_page' WHEN {n} + {menu} < 200 THEN 'empty_shell' WHEN {n} + {menu} < 400 AND len(ls) + 3 >= 20 THEN 'list_page' ELSE '' END
 WHEN {n} + {menu} < 200 THEN 'empty_shell' WHEN s = 'photo_set' AND ({captioned}) THEN 'photo_set' ELSE '' END"""
    return {
        "plain_titles": f"WITH {_title_sql('(SELECT line_no, id, title FROM mini_pred WHERE title IS NOT NULL)', 'line_no')} SELECT line_no, title FROM titled",
        "extracted_titles": f"WITH {_title_sql('(SELECT line_no, id, title FROM mini_pred WHERE id IS NOT NULL)', 'line_no')} SELECT line_no, nullif(title, '') AS title FROM titled",
        "credible_authors": f"SELECT line_no, array_to_string(list_filter(list_transform(authors, lambda x: {_person_sql('x')}), lambda y: y IS NOT NULL AND NOT {_category_sql('y')}), '; ') AS authors FROM mini_pred",
        "extracted_times": f"SELECT line_no, p AS publish, publish_offset, CASE WHEN u IS DISTINCT FROM p THEN u END AS update FROM (SELECT line_no, {time('publish_time.value')} AS p, {offset} AS publish_offset, {time('update_time.value')} AS u FROM mini_pred WHERE id IS NOT NULL)",
        "extracted_texts": f"SELECT line_no, CASE WHEN (list_max(list_transform(ls, lambda l: length(l))) >= 25 AND {_LENGTHS} + len(ls) - 1 >= 140) OR {_LENGTHS} >= 200 THEN array_to_string(ls, chr(10)) END AS content_text FROM (SELECT line_no, {_LINE_SQL} AS ls FROM mini_pred WHERE id IS NOT NULL)",
        "spoken_times": f"SELECT line_no, coalesce({time('update_time.value')}, CASE WHEN regexp_matches({u}, '{dotted}') THEN {by_number} WHEN regexp_matches({u}, '{named}') AND {day} <> '' THEN {by_name} END) AS value FROM mini_pred WHERE update_time.value IS NOT NULL",
        "refused_pages": f"SELECT s AS structure, r AS reason, count(*) AS pages FROM (SELECT s, {reason} AS r FROM (SELECT DISTINCT id, coalesce(content_structure, 'none') AS s, content_text, {_LINE_SQL} AS ls FROM mini_gold)) GROUP BY ALL",
        "page_facts": f"SELECT line_no, strlen(h)::BIGINT AS bytes, sha1(h) AS sha1, 'utf-8' AS encoding_declared FROM (SELECT line_no, {html} AS h FROM mini_pred WHERE id IS NOT NULL)",
        "site_links": f"SELECT DISTINCT site, 'https://' || site || '.example' || p AS url FROM (SELECT {_SITE_SQL} AS site, unnest(['/', '/world', '/sport']) AS p FROM mini_pred WHERE id IS NOT NULL) WHERE site <> ''",
    }


QUERIES = {
    f.__name__: f
    for f in (extracted_titles, extracted_times, extracted_texts, extracted_authors, extract_records, refused_pages, refusal_calibration, page_facts, site_links, plain_titles, credible_authors, spoken_times)
}
ORACLES = oracles()
