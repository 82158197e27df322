"""Mixed timestamp formats and zones, normalised to UTC instants.

Each value is parsed into its parts by JVM regular expressions. A purely numeric date that doesn't start
with its year has up to two valid readings; which one a source means is estimated by expectation-maximisation
over a mixture of day-first and month-first formats per source. Sufficient statistics of a source are three
counts (values valid under both readings, only day first, only month first), so the iterations run as
column expressions over one aggregated row per source. A known order of a source enters as a prior weight.
Values whose posterior stays undecided are marked, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.session import cut

# Month names by their first letters, lower case, without accents or dots.
MONTHS = {
    "jan": 1, "ene": 1, "янв": 1, "feb": 2, "fev": 2, "фев": 2, "mar": 3, "mär": 3, "mrz": 3, "мар": 3, "apr": 4, "abr": 4, "avr": 4, "апр": 4,
    "may": 5, "mai": 5, "мая": 5, "май": 5, "jun": 6, "juin": 6, "июн": 6, "jul": 7, "juil": 7, "июл": 7, "aug": 8, "ago": 8, "aou": 8, "авг": 8,
    "sep": 9, "set": 9, "сен": 9, "oct": 10, "okt": 10, "out": 10, "окт": 10, "nov": 11, "ноя": 11, "dec": 12, "dez": 12, "dic": 12, "дек": 12,
}
# Minutes east of UTC of zone abbreviations. CST and IST name several zones and aren't here.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "npt": 345,
    "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "nst": -210, "ndt": -150, "brt": -180,
}
# Abbreviations that mean different offsets in different zones.
ZONES_BY_PLACE = {"cst": {"Asia/": 480, "America/": -360}, "ist": {"Asia/Kolkata": 330, "Asia/Jerusalem": 120, "Europe/": 60}}

#: Posterior from which a reading counts as settled; weight of a source's known order against its own values; EM rounds.
SETTLED, PRIOR_WEIGHT, ROUNDS = 0.99, 1e9, 20


def _lookup(name: Column, table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[name]


def _int(text: Column) -> Column:
    return F.when(text != "", text).otherwise(None).cast("int")


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01; null where the date doesn't exist."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.unix_date(F.try_to_date(F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text), "yyyy-MM-dd")).cast("long")


def offset_seconds(text: Column) -> Column:
    """Seconds east of UTC of an offset as written: Z, +08:00, +0800, +8, UTC+8, GMT+05:30 or an unambiguous zone name."""
    t = F.lower(F.regexp_replace(F.translate(text, "−–", "--"), "[\\s()]", ""))
    pattern = "^(?:utc|gmt)?([+-])(\\d{1,2}):?(\\d{2})?$"
    hours, minutes = _int(F.regexp_extract(t, pattern, 2)), F.coalesce(_int(F.regexp_extract(t, pattern, 3)), F.lit(0))
    value = (hours * 60 + minutes) * F.when(F.regexp_extract(t, pattern, 1) == "-", -60).otherwise(60)
    return F.when(t.rlike(pattern), F.when((hours <= 14) & (minutes < 60), value)).otherwise(_lookup(t, ZONES) * 60).cast("long")


# The written forms of dates and of the clock behind them.
NUMBER = "(\\d{1,2})"
YMD = f"^(\\d{{4}})(?:-{NUMBER}-{NUMBER}|/{NUMBER}/{NUMBER}|\\.{NUMBER}\\.{NUMBER}|年 ?{NUMBER}月 ?{NUMBER}(?:日|(?!\\d)))(?:(?<=日)|(?!\\d))"
NUMERIC = f"^{NUMBER}([./-]){NUMBER}\\2(\\d{{4}})(?!\\d)"
DAY_FIRST = f"^{NUMBER}(?:st|nd|rd|th|er|\\.|º)? (?:de )?(\\p{{L}}{{3,}})\\.?,? (?:de )?(\\d{{4}})(?: г\\.?)?(?!\\d)"
MONTH_FIRST = f"^(\\p{{L}}{{3,}})\\.? {NUMBER}(?:st|nd|rd|th)?,? (\\d{{4}})(?!\\d)"
CLOCK = "^(?:t|[\\s,|-]| um | at | às | à | в )*(上午|下午|凌晨|晚上)?\\s?(\\d{1,2})(?:[:.h时點点]|h )(\\d{2})(?:分?(?![\\d:.])|[:.分](\\d{2}|xx)(?:秒)?(?:[.,]\\d{1,9})?)\\s*(?:uhr|h|分)?(?![\\d:])"
PREFIX = "^(?:updated|published|posted|modified|last updated|aktualisiert|stand|actualizado|atualizado|publié|mis à jour|обновлено|更新|发布)(?:时间|于)?\\s*:?\\s*"
WEEKDAY = "^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,? (?=\\d|[a-z])"


def _month(name: Column) -> Column:
    plain = F.translate(name, "éèêûôçã", "eeeuoca")
    return F.coalesce(_lookup(F.substring(plain, 1, 4), MONTHS), _lookup(F.substring(plain, 1, 3), MONTHS))


def parse(df: DataFrame, value: str, zone: str) -> DataFrame:
    """``df`` with ``p``, the parts of the written time ``value``: ``kind`` (epoch, date, numeric), ``seconds`` (of an epoch),
    ``y a b`` (year, then month and day, or the two numbers of a numeric date in their order), ``clock`` (seconds of the
    day) and ``offset`` (seconds east of UTC, as written). Steps are separate columns, so that none is evaluated twice."""
    v = F.lower(F.trim(F.regexp_replace(F.translate(F.col(value), "：／．，－\u00a0\u202f\u3000", ":/.,-   "), "\\s+", " ")))
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, PREFIX, ""), WEEKDAY, ""), "^(?:le|am|el|on|em) (?=\\d)", "")
    df = df.withColumn("_v", v)
    form = F.when(F.col("_v").rlike("^\\d{10}$|^\\d{13}$"), "epoch")
    for name, pattern in (("ymd", YMD), ("numeric", NUMERIC), ("day", DAY_FIRST), ("month", MONTH_FIRST)):
        form = form.when(F.col("_v").rlike(pattern), name)
    df = df.withColumn("_form", form)

    def groups(p: str, numbers: list) -> Column:
        return F.array(*[F.regexp_extract("_v", p, g) for g in numbers], F.substring("_v", F.length(F.regexp_extract("_v", p, 0)) + 1, 10**6))

    def ymd_parts() -> Column:
        g = F.regexp_replace(F.regexp_extract("_v", YMD, 0), "[年月/.]", "-")
        pieces = F.split(F.regexp_replace(g, "[日 ]", ""), "-")
        return F.concat(F.slice(pieces, 1, 3), F.array(F.substring("_v", F.length(F.regexp_extract("_v", YMD, 0)) + 1, 10**6)))

    parts = F.when(F.col("_form") == "ymd", ymd_parts()).when(F.col("_form") == "numeric", groups(NUMERIC, [4, 1, 3])).when(F.col("_form") == "day", groups(DAY_FIRST, [3, 2, 1])).when(F.col("_form") == "month", groups(MONTH_FIRST, [3, 1, 2]))
    df = df.withColumn("_parts", parts).withColumn("_rest", F.col("_parts")[3])
    df = df.withColumn("_clock", F.when(F.col("_rest").rlike(CLOCK), F.array(*[F.regexp_extract("_rest", CLOCK, g) for g in (0, 1, 2, 3, 4)])))
    df = df.withColumn("_after", F.trim(F.substring("_rest", F.length(F.col("_clock")[0]) + 1, 10**6)))
    df = df.withColumn("_half", F.coalesce(F.nullif(F.col("_clock")[1], F.lit("")), F.regexp_extract("_after", "^([ap]\\.?m)\\b", 1)))
    df = df.withColumn("_zone", F.trim(F.regexp_replace(F.regexp_replace("_after", "^[ap]\\.?m\\.?(?![a-z])", ""), "[()]", "")))
    h, mi, s = _int(F.col("_clock")[2]), _int(F.col("_clock")[3]), F.coalesce(_int(F.nullif(F.col("_clock")[4], F.lit("xx"))), F.lit(0))
    pm, am = F.col("_half").isin("下午", "晚上") | F.col("_half").startswith("p"), F.col("_half").isin("上午", "凌晨") | F.col("_half").startswith("a")
    df = df.withColumn("_h", F.when(pm & (h < 12), h + 12).when(am & (h == 12), 0).otherwise(h))
    of_day = F.when((F.col("_h") <= 23) & (mi <= 59) & (s <= 60), F.col("_h") * 3600 + mi * 60 + s)
    by_place = F.coalesce(*[F.when((F.col("_zone") == name) & F.col(zone).startswith(place), minutes * 60) for name, places in ZONES_BY_PLACE.items() for place, minutes in places.items()])
    df = df.withColumn("_off", F.coalesce(offset_seconds(F.col("_zone")), by_place))
    named = F.col("_form").isin("day", "month")
    p = F.struct(
        F.when(F.col("_form").isin("ymd", "day", "month"), "date").otherwise(F.col("_form")).alias("kind"),
        F.when(F.col("_form") == "epoch", F.substring("_v", 1, 10).cast("long")).alias("seconds"),
        _int(F.col("_parts")[0]).alias("y"),
        F.when(named, _month(F.col("_parts")[1])).otherwise(_int(F.when(~named, F.col("_parts")[1]))).alias("a"),
        _int(F.col("_parts")[2]).alias("b"),
        F.when((F.col("_zone") == "") | F.col("_off").isNotNull(), of_day).cast("long").alias("clock"),  # something unread behind the clock leaves it unread
        F.col("_off").cast("long").alias("offset"),
    )
    return df.withColumn("p", p).drop("_v", "_form", "_parts", "_rest", "_clock", "_after", "_half", "_zone", "_h", "_off")


def order_posteriors(parsed: DataFrame, source: str, known: str) -> DataFrame:
    """(``source``, ``p_day_first``): posterior that a numeric date of the source, valid both ways, has its day first.

    EM for the mixture weight w of day-first values. E step: a value valid both ways is day first with
    probability w, one valid one way only is certain. M step: w is the expected share, with the prior of the
    known order (``dmy``, ``mdy``, else none) added. Only aggregated counts are iterated.
    """
    ones, both = (F.col("p.a") <= 12), (F.col("p.a") <= 12) & (F.col("p.b") <= 12) & (F.col("p.a") != F.col("p.b"))
    counts = parsed.where("p.kind = 'numeric'").groupBy(source).agg(
        F.count_if(both).cast("double").alias("n_both"),
        F.count_if(~ones & (F.col("p.b") <= 12)).cast("double").alias("n_day"),
        F.count_if(ones & (F.col("p.b") > 12)).cast("double").alias("n_month"),
        F.max(known).alias("known"),
    )
    day0 = 1 + F.when(F.col("known") == "dmy", PRIOR_WEIGHT).otherwise(0.0)
    month0 = 1 + F.when(F.col("known") == "mdy", PRIOR_WEIGHT).otherwise(0.0)
    step = lambda w, _: (day0 + F.col("n_day") + F.col("n_both") * w) / (day0 + month0 + F.col("n_day") + F.col("n_month") + F.col("n_both"))
    start = (day0 + F.col("n_day")) / (day0 + month0 + F.col("n_day") + F.col("n_month"))
    return counts.select(source, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("p_day_first"))


def _text(seconds: Column) -> Column:
    """YYYY-MM-DD hh:mm:ss of seconds since 1970 in UTC, whatever the session's zone."""
    day, clock = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit(" "), two(clock / 3600), F.lit(":"), two((clock % 3600) / 60), F.lit(":"), two(clock % 60))


def to_utc(df: DataFrame, value: str, offset: str, zone: str, source: str, order: str) -> DataFrame:
    """``df`` with ``status`` and ``utc_value`` (``YYYY-MM-DD hh:mm:ss`` in UTC, null unless ``status`` is ``ok``).

    ``value`` is the written time, ``offset`` the offset beside it, ``zone`` the IANA zone of the source, ``source`` names
    it, ``order`` is its known order of numeric dates; any may be null. The offset or zone inside the value holds first,
    then ``offset``, then ``zone``. Status: ``ok``; ``empty`` (null or blank); ``unread`` (no known form, relative words,
    a date that doesn't exist); ``coarse`` (no hour and minute); ``order`` (numeric date that stays ambiguous);
    ``no_zone``; ``skipped`` and ``twice`` (local time that the zone's clock skips or shows twice). Every row of
    ``df`` comes out once. Columns of ``df`` called ``status``, ``utc_value``, ``p`` or ``p_day_first`` are replaced.
    """
    df = df.drop("status", "utc_value", "p", "p_day_first")
    parsed = cut(parse(df, value, zone))  # read twice: for the mixtures and for the values
    weights = order_posteriors(parsed, source, order).withColumnRenamed(source, "_source")
    parsed = parsed.join(weights, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
    a, b, y = F.col("p.a"), F.col("p.b"), F.col("p.y")
    day_first, month_first = (b <= 12), (a <= 12)
    settled = (
        F.when(F.col("p.kind").isNull(), None)
        .when(F.col("p.kind") != "numeric", "md")
        .when(day_first & ~month_first, "dm")
        .when(month_first & ~day_first, "md")
        .when((a == b) & day_first, "md")
        .when(~day_first & ~month_first, None)
        .when(F.col("p_day_first") >= SETTLED, "dm")
        .when(F.col("p_day_first") <= 1 - SETTLED, "md")
        .otherwise("open")
    )
    parsed = parsed.withColumn("_order", settled)
    month_of, day_of = F.when(F.col("_order") == "dm", b).when(F.col("_order") == "md", a), F.when(F.col("_order") == "dm", a).when(F.col("_order") == "md", b)
    parsed = parsed.withColumn("_month", month_of).withColumn("_dom", day_of).withColumn("_day", _days(y, F.col("_month"), F.col("_dom")))
    parsed = parsed.withColumn("_local", F.col("_day") * 86400 + F.col("p.clock"))
    given = F.coalesce(F.col("p.offset"), offset_seconds(F.col(offset)))
    parsed = parsed.withColumn("_given", given)
    wall = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), F.col(zone)))
    by_zone = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.col("_local")), F.col(zone)))
    parsed = parsed.withColumn("_zoned", F.when(F.col("_given").isNull() & F.col("_local").isNotNull() & F.col(zone).isNotNull(), by_zone))
    parsed = parsed.withColumn("_wall", wall(F.col("_zoned")))
    steps = F.array(*[F.lit(s * 60 * m) for m in (30, 60, 120) for s in (-1, 1)])
    twin = F.exists(steps, lambda d: wall(F.col("_zoned") + d) == F.col("_local"))
    blank = F.col(value).isNull() | (F.trim(F.regexp_replace(F.col(value), "[\\u00a0\\u3000]", " ")) == "")
    status = (
        F.when(blank, "empty")
        .when(F.col("p.kind") == "epoch", "ok")
        .when(F.col("_order") == "open", "order")
        .when(F.col("p.kind").isNull() | F.col("_day").isNull(), "unread")
        .when(F.col("p.clock").isNull(), "coarse")
        .when(F.col("_given").isNotNull(), "ok")
        .when(F.col(zone).isNull(), "no_zone")
        .when(F.col("_wall") != F.col("_local"), "skipped")
        .when(twin, "twice")
        .otherwise("ok")
    )
    seconds = F.coalesce(F.col("p.seconds"), F.col("_local") - F.col("_given"), F.col("_zoned"))
    out = parsed.withColumn("status", status).withColumn("_utc", seconds)
    out = out.withColumn("utc_value", F.when(F.col("status") == "ok", _text(F.col("_utc"))))
    return out.select(*df.columns, "status", "utc_value")
