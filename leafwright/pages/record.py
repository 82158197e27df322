"""Pages to records, distributed: one Arrow pass reads, native columns decide.

``extract`` takes (id, site, raw) and gives a record a page. The pass emits what stands on the page: measures, meta tags, JSON-LD,
texts of places, candidates for the body. What of it holds is decided by column expressions: refusal, precedence
between sources, site rules, grammars, names, vetoes; so thresholds, forms and orders stay visible to the
optimizer and can be swept. A page that can't be read gives a record with ``error`` and nothing else; the batch goes on.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.functions.columns import date_candidates, let, spoken_time, squeezed, written_time
from leafwright.pages import body, evidence, names, refusal, titles
from leafwright.pages.decode import decode
from leafwright.pages.dom import BLANKS, parse, select, select_all

TIME = "struct<value: string, utc_offset: string, utc_offset_source: string>"
IMAGES = "array<struct<type: string, alt: string, caption: string, url: string, width: string, height: string>>"
READ = (
    f"id string, site string, encoding struct<declared: string, detected: string, used: string>, measures struct<{', '.join(x.replace(' ', ': ', 1) for x in refusal.MEASURES.split(', ', 8))}>, properties map<string, string>, names map<string, string>, "
    "ld array<struct<headline: string, authors: array<string>, published: string, modified: string>>, heading string, heading_marks array<string>, title_tag string, page_text string, near array<string>, places array<string>, "
    f"captions array<string>, fields map<string, array<string>>, content_text string, content_md string, content_from string, images {IMAGES}, conversion_flags array<string>, ms map<string, double>, error string"
)
#: Marks an offset that comes from where a site is at home, not from the page.
INFERRED = "inferred_site_locale"


@dataclass(frozen=True)
class Credit:
    """Names in a site's texts: in image captions (``caption``), in lines of the article (``line``) or in a field of the rule. The first of ``patterns`` that fits holds."""

    place: str
    patterns: tuple[str, ...]
    role: str | None = None
    separator: str = "[\\s、，,]+"
    shape: str = "^[一-龥]{2,4}$"


@dataclass(frozen=True)
class SiteRule:
    """What is known of a site's pages, as data. ``fields`` names texts of selected elements for the patterns to read.

    ``times`` maps a time field to (field or meta tag, pattern, what is appended); ``final`` names record fields that no other source may fill if the rule finds nothing.
    """

    site: str
    titles: tuple[str, ...] = ("h1",)
    container: str | None = None
    captions: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    times: tuple[tuple[str, str, str, str], ...] = ()
    offset: str | None = None
    publisher: tuple[str, str] | None = None
    credits: tuple[Credit, ...] = ()
    editor_meta: str | None = None
    final: tuple[str, ...] = ()


# Rules of three sites.
RULES = (
    SiteRule(
        "news_cn", container="div#detail", captions="news_cn", fields=(("info", ("div.info",)), ("editor", ("span.editor",))),
        times=(("publish_time", "info", "(\\d{4}-\\d{2}-\\d{2}\\s+\\d{2}:\\d{2}:\\d{2})", ""),), offset="+08:00", publisher=("info", "来源[:：]\\s*(\\S+)"),
        credits=(
            Credit("caption", ("新华社发（([^）]+?)\\s*摄）", "新华社记者\\s+([^，。]+?)\\s+摄"), "摄影"),
            Credit("line", ("^文字记者：(.+)$",)),
            Credit("line", ("^海报设计：(.+)$",), "海报设计"),
            Credit("editor", ("责任编辑[:：]\\s*([一-龥]{2,4})",), "责任编辑"),
        ),
    ),
    SiteRule(
        "chinadaily", container="div#Content", captions="figure", fields=(("byline", ("span.info_l", "div.Artical_Info")),),
        times=(("update_time", "byline", "Updated:\\s*(\\d{4}-\\d{2}-\\d{2}\\s+\\d{2}:\\d{2})", ""),), offset="+08:00",
        credits=(
            Credit("byline", ("^By\\s+(.+?)\\s*\\|", "(?i)^(?!By\\s)(?!chinadaily\\.com\\.cn|china daily)([^|]*?)\\s*(?:\\||$)"), None, "\\s+and\\s+", "(?i)^(?!chinadaily\\.com\\.cn$|china daily$)(?!.*updated).+$"),
            Credit("caption", ("^([A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+)*)\\s*/\\s*CHINA DAILY\\s*$",), "摄影", "\\n", ".+"),
        ),
        final=("publish_time", "authors"),
    ),
    SiteRule(
        "gov_cn", titles=("h1", "div.share-title"), container="div#UCAP-CONTENT", fields=(("date", ("div.pages-date",)),), offset="+08:00", publisher=("date", "来源[:：]\\s*(\\S+)"), editor_meta="author",
        times=(("publish_time", "meta:firstpublishedtime", "(.+)", ""), ("update_time", "meta:lastmodifiedtime", "(.+)", "")),
    ),
)
#: Where a person was, behind their name in a byline.
WHEREABOUTS = "\\s+in\\s+[A-Z][A-Za-z]+$"


def read_page(page_id: str, site: str | None, raw: bytes, rules: dict[str, SiteRule]) -> dict:
    """What stands on one page, as a row of :data:`READ`."""
    clock = [time.perf_counter()]
    lap = lambda: clock.append(time.perf_counter())
    html, declared, detected, used = decode(raw)
    lap()
    root = parse(html)
    lap()
    rule = rules.get(site or "")
    fields: dict[str, list[str]] = {}
    if rule:
        for name, selectors in rule.fields:
            chosen = next((x for x in (list(select_all(root, s)) for s in selectors) if x), [])
            fields[name] = [BLANKS.sub(" ", n.text()) for n in chosen]
        node = next((n for n in (select(root, s) for s in rule.titles) if n is not None and n.text()), None)
        if node is not None:
            fields["title"] = [BLANKS.sub(" ", node.text())]
    heading, marks = evidence.heading(root)
    title_tag = root.first("title")
    near, places, captions = evidence.places(root)
    properties, named = evidence.meta_tags(root)
    ld, measures = evidence.json_ld(root), refusal.measure(root)
    lap()
    own, origin = body.main_content(root, (rule.container, rule.captions) if rule and rule.container else None, heading)
    lap()
    return {
        "id": page_id, "site": site, "encoding": {"declared": declared, "detected": detected, "used": used}, "measures": measures, "properties": properties, "names": named, "ld": ld,
        "heading": heading, "heading_marks": marks, "title_tag": (title_tag.text() or None) if title_tag is not None else None, "page_text": root.text("\n"), "near": near, "places": places, "captions": captions, "fields": fields,
        "content_text": (own.text or None) if own else None, "content_md": (own.md or None) if own else None, "content_from": origin, "images": own.images if own else [], "conversion_flags": sorted(set(own.flags)) if own else [],
        "ms": {stage: 1000 * (b - a) for stage, a, b in zip(("decode", "parse", "evidence", "body"), clock, clock[1:])}, "error": None,
    }


def read(pages: DataFrame, rules: tuple[SiteRule, ...] = RULES) -> DataFrame:
    """(id, site, raw) to rows of :data:`READ`. ``raw`` may be binary or text; other columns aren't read. A null page is an empty one."""
    schema = T._parse_datatype_string(READ)
    by_site = {r.site: r for r in rules}
    shared = pages.sparkSession.sparkContext.broadcast(by_site)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = []
            for page_id, site, raw in zip(batch["id"], batch["site"], batch["raw"]):
                try:
                    rows.append(read_page(page_id, site, bytes(raw or b""), own))
                except Exception as e:  # noqa: BLE001  one broken page must not end the batch
                    rows.append({f.name: None for f in schema.fields} | {"id": page_id, "site": site, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return pages.select("id", "site", F.col("raw").cast("binary").alias("raw")).mapInPandas(run, schema)


_STRINGS = "array<string>"


def _listed(x: Column) -> Column:
    return F.coalesce(x, F.array().cast(_STRINGS))


def _told(value: Column, origin: Column | str) -> Column:
    """(value, from), null where there is no value."""
    source = F.lit(origin) if isinstance(origin, str) else origin
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), source.alias("from"))))


def _meta(keys: tuple[str, ...]) -> tuple[Column, Column]:
    """Content and name of the first of the meta tags that isn't blank; a property beats a name."""
    each = [(k, F.coalesce(F.try_element_at("properties", F.lit(k)), F.try_element_at("names", F.lit(k)))) for k in keys]
    return F.coalesce(*[F.when(v != "", v) for _, v in each]), F.coalesce(*[F.when(v != "", F.lit(f"meta:{k}")) for k, v in each])


def _first_time(texts: Column) -> Column:
    """The first of several texts that is a written time."""
    return F.get(F.filter(F.transform(_listed(texts), written_time), lambda t: t.isNotNull()), F.lit(0))


def _time(time: Column, offset: str | None = None) -> Column:
    """A written time with where its offset comes from; ``offset`` fills one that isn't written."""
    return let(time, lambda t: _with_source(t, F.lit(offset).cast("string")))


def _with_source(t: Column, filled: Column) -> Column:
    source = F.when(t["utc_offset"].isNull() & filled.isNotNull(), INFERRED)
    return F.when(t.isNotNull(), F.struct(t["value"].alias("value"), F.coalesce(t["utc_offset"], filled).alias("utc_offset"), source.alias("utc_offset_source")))


def _by_rule(rules: tuple[SiteRule, ...], of, kind: str) -> Column:  # noqa: ANN001
    """CASE over sites of what ``of`` makes of their rules."""
    out = F.lit(None).cast(kind)
    for rule in rules:
        if (value := of(rule)) is not None:
            out = F.when(F.col("site") == rule.site, value).otherwise(out)
    return out


def _field(name: str) -> Column:
    return F.get(_listed(F.try_element_at("fields", F.lit(name))), F.lit(0))


def _rule_time(field: str):  # noqa: ANN202
    def of(rule: SiteRule) -> Column | None:
        for target, place, pattern, _ in rule.times:
            if target == field:
                text = F.try_element_at("names", F.lit(place[5:])) if place.startswith("meta:") else _field(place)
                written = written_time(squeezed(F.regexp_extract(text, pattern, 1)))
                kept = lambda t: F.struct(t["value"].alias("value"), F.lit(rule.offset).cast("string").alias("utc_offset"), F.lit(INFERRED).alias("utc_offset_source"))
                return let(written, lambda t: F.when(t.isNotNull(), kept(t)))
        return None

    return of


def _credited(credit: Credit) -> Column:
    texts = {"caption": F.transform("images", lambda i: i["caption"]), "line": F.split(F.coalesce("content_text", F.lit("")), "\n")}.get(credit.place, F.try_element_at("fields", F.lit(credit.place)))

    def of(text: Column) -> Column:
        found = [F.regexp_extract(F.coalesce(text, F.lit("")), p, 1) for p in credit.patterns]
        held = F.coalesce(*[F.when(x != "", x) for x in found], F.lit(""))
        parts = F.transform(F.split(held, credit.separator), lambda n: F.trim(F.regexp_replace(n, WHEREABOUTS, "")))
        return F.filter(parts, lambda n: (n != "") & n.rlike(credit.shape))

    people = F.flatten(F.transform(_listed(texts), of))
    return F.transform(people, lambda n: F.concat(n, F.lit(f"（{credit.role}）"))) if credit.role else people


def _rule_authors(rule: SiteRule) -> Column | None:
    if rule.editor_meta:
        editor = F.try_element_at("names", F.lit(rule.editor_meta))
        return F.when(editor != "", F.array(F.concat(editor, F.lit("（责任编辑）"))))
    if not rule.credits:
        return None
    people = F.array_distinct(F.concat(*map(_credited, rule.credits)))
    return F.when(F.size(people) > 0, people)


def _final(rules: tuple[SiteRule, ...], field: str) -> Column:
    return F.coalesce(F.col("site").isin([r.site for r in rules if field in r.final]), F.lit(False))


def _refined(publish: Column, near: Column, page_text: Column) -> Column:
    """A publication time of a day, with the clock of the byline or of another date on the page that names the same day. Never a new day."""
    day = lambda t: F.left(t["value"], F.lit(10))
    coarse = lambda t: F.substring(t["value"], 12, 2) == "XX"
    close = F.coalesce(~coarse(near) & (day(near) == day(publish)), F.lit(False))
    byline = F.struct(near["value"].alias("value"), F.coalesce(near["utc_offset"], publish["utc_offset"]).alias("utc_offset"), F.when(near["utc_offset"].isNotNull(), near["utc_offset_source"]).otherwise(publish["utc_offset_source"]).alias("utc_offset_source"))
    others = F.filter(F.transform(date_candidates(page_text), lambda d: spoken_time(d)["value"]), lambda v: (F.left(v, F.lit(10)) == day(publish)) & (F.substring(v, 12, 2) != "XX"))
    other = F.when(F.size(others) > 0, F.struct(F.get(others, F.lit(0)).alias("value"), publish["utc_offset"].alias("utc_offset"), publish["utc_offset_source"].alias("utc_offset_source")))
    return F.when(F.coalesce(coarse(publish), F.lit(False)), F.when(close, byline).otherwise(F.coalesce(other, publish))).otherwise(publish)


def resolve(found: DataFrame, rules: tuple[SiteRule, ...] = RULES, offset: str | None = None, limits: dict[str, float | Column] | None = None) -> DataFrame:
    """Rows of :data:`READ` to records. Precedence, in order: a field's veto, the site's rule, meta tags, JSON-LD, headings and bylines.

    ``offset`` is assumed for times in bylines that have none; ``limits`` replaces thresholds of refusal.
    """
    none = F.lit(None).cast("string")
    rows = found.withColumn("_why", F.when(F.col("error").isNull(), refusal.verdict(F.col("measures"), limits)))
    rows = rows.withColumn("_in", F.col("_why").isNull() & F.col("error").isNull()).withColumn("_lines", names.short_lines(F.col("page_text")))
    ruled = F.coalesce(F.col("site").isin([r.site for r in rules]), F.lit(False))
    # title
    meta_title, meta_from = _meta(evidence.META["title"])
    headline = F.get(F.filter(F.transform("ld", lambda n: n["headline"]), lambda h: h != ""), F.lit(0))
    own = F.coalesce(_told(F.when(ruled, _field("title")), "dom:rule"), _told(meta_title, meta_from), _told(headline, "json-ld:headline"), _told(F.nullif("heading", F.lit("")), "dom://h1"), _told(F.nullif("title_tag", F.lit("")), "dom://title"))
    rows = rows.withColumn("_own", own)
    bare = titles.without_brand(F.col("_own.value"), F.col("site"))
    rows = rows.withColumn("_bare", F.when(F.col("_own.from") == "dom:rule", squeezed(F.col("_own.value"))).otherwise(bare))
    claimed = F.coalesce(F.col("_own.from").startswith("meta:") | F.col("_own.from").startswith("json-ld:"), F.lit(False))
    rows = rows.withColumn("_other", claimed & titles.contradicted(F.col("_bare"), F.col("heading"), F.col("heading_marks")))
    title = F.when(F.col("_other"), titles.without_brand(F.col("heading"), F.col("site"))).otherwise(F.col("_bare"))
    title_from = F.when(F.col("_other"), "dom://h1").otherwise(F.col("_own.from"))
    # times
    for field, ld_key in (("publish_time", "published"), ("update_time", "modified")):
        text, origin = _meta(evidence.META[field])
        by_rule = _by_rule(rules, _rule_time(field), TIME)
        by_ld = _first_time(F.transform("ld", lambda n: n[ld_key]))  # noqa: B023
        claimed_time = F.when(~_final(rules, field), F.coalesce(_told(_time(written_time(text)), origin), _told(_time(by_ld), "json-ld:date")))
        rows = rows.withColumn(f"_{field}", F.coalesce(_told(by_rule, "dom:rule"), claimed_time))
    near = _time(_first_time(F.col("near")), offset)
    rows = rows.withColumn("_near", near).withColumn("_publish", F.col("_publish_time.value"))
    update = F.when(~ruled & (F.col("_update_time.value.value") == F.col("_publish.value")), None).otherwise(F.col("_update_time.value"))  # a copy by the publishing system
    publish = F.when(F.col("_publish").isNotNull(), _refined(F.col("_publish"), F.col("_near"), F.col("page_text"))).when(~_final(rules, "publish_time"), F.col("_near"))
    publish_from = F.when(F.col("_publish").isNotNull(), F.col("_publish_time.from")).when(~_final(rules, "publish_time") & F.col("_near").isNotNull(), "dom:byline")
    # authors
    text, origin = _meta(evidence.META["authors"])
    split = F.filter(F.transform(F.split(text, "[,;，、；]"), lambda n: F.trim(n)), lambda n: n != "")
    by_ld = F.get(F.filter(F.transform("ld", lambda n: n["authors"]), lambda a: F.size(a) > 0), F.lit(0))
    claims = F.coalesce(_told(F.when(F.size(split) > 0, split), origin), _told(by_ld, "json-ld:author"))
    rows = rows.withColumn("_rule_people", _by_rule(rules, _rule_authors, _STRINGS)).withColumn("_claims", claims)
    fit = names.credible(F.filter(F.transform("_claims.value", names.clean), lambda n: n.isNotNull()), F.col("_lines"))
    claimed_people = names.without_site(fit, F.col("site"))
    vetoed = _final(rules, "authors")
    people = F.coalesce(F.col("_rule_people"), F.when(~vetoed & (F.size(claimed_people) > 0), claimed_people))
    rows = rows.withColumn("_people", people).withColumn("_signed", names.bylines(F.col("places"), F.col("captions"), F.col("content_text"), F.col("_lines")))
    strong = F.col("_people").isNotNull() & F.col("_rule_people").isNull() & ~ruled
    merged = F.concat(_listed(F.col("_people")), F.filter("_signed", lambda n: ~F.array_contains(F.transform(_listed(F.col("_people")), names.person), names.person(n))))
    authors = F.when(strong | vetoed, F.col("_people")).otherwise(merged)
    authors_from = F.when(F.col("_rule_people").isNotNull(), "dom:rule").when(F.col("_people").isNotNull(), F.col("_claims.from")).when(~vetoed & (F.size("_signed") > 0), "byline")
    publisher = _by_rule(rules, lambda r: F.nullif(F.regexp_extract(_field(r.publisher[0]), r.publisher[1], 1), F.lit("")) if r.publisher else None, "string")
    finals = F.array_compact(F.array(*[F.when(_final(rules, f), f) for f in ("publish_time", "authors")]))
    rows = rows.withColumns({"_title": title, "_title_from": title_from, "_authors": F.when(F.size(authors) > 0, authors), "_authors_from": authors_from, "_published": publish, "_publish_from": publish_from, "_updated": update})
    keep = lambda c: F.when(F.col("_in"), c)
    structure = F.when(F.col("_why").isin("list_page", "photo_set"), F.col("_why")).otherwise("single")
    evidence_of = F.create_map(F.lit("title"), F.when(F.col("_title").isNotNull(), F.col("_title_from")), F.lit("authors"), "_authors_from", F.lit("publish_time"), "_publish_from", F.lit("update_time"), F.when(F.col("_updated").isNotNull(), F.col("_update_time.from")), F.lit("content_text"), F.when(F.col("content_text").isNotNull(), F.col("content_from")), F.lit("content_md"), F.when(F.col("content_md").isNotNull(), F.col("content_from")), F.lit("images"), F.when(F.size("images") > 0, F.col("content_from")), F.lit("source.publisher"), F.when(publisher.isNotNull(), "dom:rule"))
    return rows.select(
        "id", "site", keep(F.col("_title")).alias("title"), keep(F.col("_authors")).alias("authors"), keep(F.col("_published")).alias("publish_time"), keep(F.col("_updated")).alias("update_time"),
        keep(F.col("content_text")).alias("content_text"), keep(F.col("content_md")).alias("content_md"), keep(F.when(F.size("images") > 0, F.col("images"))).alias("images"), keep(F.col("conversion_flags")).alias("conversion_flags"),
        F.when(F.col("_why") == "empty_shell", "empty_shell").otherwise("ok").alias("page_condition"), F.coalesce(F.col("_why") == "empty_shell", F.lit(False)).alias("needs_render"), structure.alias("content_structure"),
        F.col("_why").isNotNull().alias("rejected"), F.struct(F.col("encoding"), keep(publisher).alias("publisher")).alias("source"), keep(F.map_filter(evidence_of, lambda _, v: v.isNotNull())).alias("provenance"),
        F.when(F.col("_why").isNotNull(), F.concat(F.lit("refused:"), "_why")).when(F.col("content_from") == "site_rules", "site_rules").when(F.col("error").isNull(), F.concat(F.lit("metadata+"), "content_from")).otherwise(none).alias("route"),
        finals.alias("final_fields"), F.when(F.col("_in"), F.col("page_text")).alias("page_text"), "error",
    )


#: Columns of a record that serve later steps and aren't part of it.
WORKING = ("final_fields", "page_text")


def extract(pages: DataFrame, rules: tuple[SiteRule, ...] = RULES, offset: str | None = None, limits: dict[str, float | Column] | None = None) -> DataFrame:
    """Records of (id, site, raw)."""
    return resolve(read(pages, rules), rules, offset, limits).drop(*WORKING)


def extract_one(spark, raw: bytes, site: str | None = None, **options) -> dict:  # noqa: ANN001, ANN003
    """The record of one page, as a dictionary."""
    return extract(spark.createDataFrame([("page", site, bytearray(raw))], "id string, site string, raw binary"), **options).first().asDict(recursive=True)
