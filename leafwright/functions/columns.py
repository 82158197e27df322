"""Column builders shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_pattern(words: list[str]) -> str:
    """A pattern for any of some lower-case words that no letter stands beside."""
    return f"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"


# Fixed value: what counts as white space besides what the engines agree on.
SPACES = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def is_empty(value: Column, kind: str) -> Column:
    """Null, an empty string or an empty array. White space alone isn't empty."""
    if kind.startswith("array"):
        return F.coalesce(F.size(value) <= 0, F.lit(True))
    if kind.startswith("struct"):
        return value.isNull()
    return F.coalesce(value == "", F.lit(True))


def share(part: Column, whole: Column) -> Column:
    """``part / whole``; null where nothing is there to share."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def paragraphs(text: Column) -> Column:
    """Number of non-blank lines."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, SPACES, "") != ""))


def smaller_share(a: Column, b: Column) -> Column:
    """Smaller over larger of two counts; null if both are 0, 0 if one is."""
    return F.when((a == 0) & (b == 0), None).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def paragraph_ratio(pred: Column, gold: Column) -> Column:
    """:func:`smaller_share` of two texts' numbers of paragraphs."""
    return smaller_share(paragraphs(pred), paragraphs(gold))


# The written forms of a time, in the order in which they are tried. The first two hold for a whole text, the last is looked for in it.
BLANK = "[\\s\\u00a0\\u3000]*"
NUMBER = "([0-9]{1,2})"
ISO_TIME = f"^([0-9]{{4}})-{NUMBER}-{NUMBER}(?:[T ]{NUMBER}:{NUMBER}(?::{NUMBER}(?:\\.[0-9]+)?)?)?{BLANK}(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?$"
HYPHEN_TIME = f"^([0-9]{{4}})-{NUMBER}-{NUMBER}-{NUMBER}:{NUMBER}(?::{NUMBER})?$"
CHINESE_TIME = f"([0-9]{{4}}){BLANK}年{BLANK}{NUMBER}{BLANK}月{BLANK}{NUMBER}{BLANK}日{BLANK}(?:{NUMBER}{BLANK}[:：]{BLANK}{NUMBER}(?:{BLANK}[:：]{BLANK}{NUMBER})?)?"


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def squeezed(text: Column) -> Column:
    """With one blank for each run of white space, and none at its ends."""
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


def time_value(parts: list[Column], unknown: str = "XX") -> Column:
    """``YYYY-MM-DD hh:mm:ss`` of year, month, day, hour, minute and second as written; an empty part becomes ``unknown``."""
    two = lambda x: F.when(x == "", unknown).otherwise(F.lpad(x, 2, "0"))
    return F.concat(parts[0], F.lit("-"), two(parts[1]), F.lit("-"), two(parts[2]), F.lit(" "), two(parts[3]), F.lit(":"), two(parts[4]), F.lit(":"), two(parts[5]))


def written_time(text: Column) -> Column:
    """``YYYY-MM-DD hh:mm:ss`` with XX for what isn't written, and the offset, of an ISO, hyphenated or Chinese time.

    A struct (value, utc_offset), null if the text has none of these forms. Numbers have one or two digits and aren't
    checked for their range; the Chinese form may have blanks anywhere and stand inside other text.
    """
    none = F.lit(None).cast("string")

    def parts(t: Column, pattern: str) -> Column:
        return time_value([F.regexp_extract(t, pattern, g) for g in range(1, 7)])

    def read(t: Column) -> Column:
        offset = let(F.regexp_extract(t, ISO_TIME, 7), lambda z: F.when(z == "", none).when(z == "Z", "+00:00").otherwise(F.concat(F.substring(z, 1, 3), F.lit(":"), F.right(z, F.lit(2)))))
        pair = lambda pattern, o: F.struct(parts(t, pattern).alias("value"), o.alias("utc_offset"))
        return F.when(t.rlike(ISO_TIME), pair(ISO_TIME, offset)).when(t.rlike(HYPHEN_TIME), pair(HYPHEN_TIME, none)).when(t.rlike(CHINESE_TIME), pair(CHINESE_TIME, none))

    return let(stripped(text), read)


#: Where the six parts of a written time stand, counted from 1, and how long they are.
PARTS = ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))


def _full(value: Column) -> Column:
    return F.rpad(F.coalesce(value, F.lit("")), 19, "X")


def time_score(pred: Column, gold: Column) -> Column:
    """1 if all parts that gold knows agree, else 0; null if gold knows none, 0 if there is no prediction."""
    p, g = _full(pred), _full(gold)
    known = [~F.substring(g, a, n).contains("X") for a, n in PARTS]
    agree = [~k | (F.substring(p, a, n) == F.substring(g, a, n)) for k, (a, n) in zip(known, PARTS)]
    some, all_agree = known[0], agree[0]
    for k, x in zip(known[1:], agree[1:]):
        some, all_agree = some | k, all_agree & x
    return F.when(pred.isNull(), 0.0).when(~some, None).when(all_agree, 1.0).otherwise(0.0)


def time_known(value: Column) -> Column:
    """Whether a written time has a part without an X."""
    padded = _full(value)
    known = F.lit(False)
    for a, n in PARTS:
        known = known | ~F.substring(padded, a, n).contains("X")
    return known


def time_confused(pred: Column, other: Column) -> Column:
    """Whether a predicted time is gold's other time, in full or down to what that knows."""
    bare = F.regexp_replace(other, "X+$", "")
    same = (_full(pred) == _full(other)) | _full(pred).startswith(bare)
    return F.coalesce((pred != "") & (other != "") & same, F.lit(False))


def zone_status(pred: Column, gold: Column) -> Column:
    return F.when(gold.isNull(), "gold_absent").when(pred.isNull(), "missing").when(pred == gold, "match").otherwise("mismatch")


def time_tag(pred: Column, gold: Column) -> Column:
    """:func:`field_tag` of written times; ``gold_all_xx`` where gold is present but has no known part to compare a prediction with."""
    tag = field_tag(pred, gold, "string")
    return F.when((tag == "ok") & ~time_known(gold), "gold_all_xx").otherwise(tag)


def field_tag(pred: Column, gold: Column, kind: str) -> Column:
    """correct_empty, false_fill, miss or ok."""
    p, g = is_empty(pred, kind), is_empty(gold, kind)
    return F.when(g & p, "correct_empty").when(g, "false_fill").when(p, "miss").otherwise("ok")


def should_reject(structure: Column, condition: Column) -> Column:
    """Whether a page should be refused: it isn't a single article, or not in order."""
    return ~structure.eqNullSafe("single") | (F.coalesce(condition, F.lit("ok")) != "ok")


# English months, and the written forms of dates that people use: day.month.year, and with the month's name on either side of the day.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAME = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
CLOCK_BEHIND = "(?:[\\s/|–-]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\\s*([ap]m)\\.?)?)?"
DOTTED_DATE = "\\b([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})(?:\\s+([0-9]{1,2}):([0-9]{2}))?"
NAMED_DATE = f"(?i)(?:([0-9]{{1,2}})(?:st|nd|rd|th)?\\s+)?({MONTH_NAME})\\.?\\s*([0-9]{{1,2}}(?![0-9]))?(?:st|nd|rd|th)?,?\\s*([0-9]{{4}}){CLOCK_BEHIND}"
DATE_CANDIDATE = (
    "(?i)\\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?|\\b[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}(?:\\s+[0-9]{1,2}:[0-9]{2})?"
    f"|\\b(?:[0-9]{{1,2}}(?:st|nd|rd|th)?\\s+)?{MONTH_NAME}\\.?\\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\\s+[0-9]{{4}}(?:[\\s/|–-]+[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?(?:\\s*[ap]m\\.?)?)?"
    f"|\\b(?:[0-9]{{1,2}}(?:st|nd|rd|th)?\\s+)?{MONTH_NAME}\\.?\\s+[0-9]{{4}}"
)


def spoken_time(text: Column) -> Column:
    """:func:`written_time`, or a dotted date or one with an English month; a struct (value, utc_offset), null if there is no day.

    A clock behind such a date may have AM or PM; seconds that aren't written are 00, a clock that isn't written XX.
    """
    none = F.lit(None).cast("string")
    pair = lambda parts: F.struct(time_value(parts).alias("value"), none.alias("utc_offset"))

    def by_number(t: Column) -> Column:
        g = [F.regexp_extract(t, DOTTED_DATE, i) for i in range(1, 6)]
        return pair([g[2], g[1], g[0], g[3], g[4], F.when(g[3] == "", "").otherwise("00")])

    def by_name(g: Column) -> Column:
        day = F.coalesce(F.nullif(g[0], F.lit("")), g[2])
        month = F.array_position(F.split(F.lit(" ".join(MONTHS)), " "), F.lower(F.substring(g[1], 1, 3))).cast("string")
        hour = F.when(g[7] == "", g[4].try_cast("int")).otherwise(g[4].try_cast("int") % 12 + F.when(F.lower(g[7]) == "pm", 12).otherwise(0))
        seconds = F.when(g[4] == "", "").otherwise(F.coalesce(F.nullif(g[6], F.lit("")), F.lit("00")))
        return F.when(day != "", pair([g[3], month, day, F.coalesce(hour.cast("string"), F.lit("")), g[5], seconds]))

    def read(t: Column) -> Column:
        named = let(F.array(*[F.regexp_extract(t, NAMED_DATE, i) for i in range(1, 9)]), by_name)
        return F.coalesce(written_time(t), F.when(t.rlike(DOTTED_DATE), by_number(t)).when(t.rlike(NAMED_DATE), named))

    return let(stripped(text), read)


def date_candidates(text: Column) -> Column:
    """The stretches of a text that may be dates, in order."""
    return F.regexp_extract_all(text, F.lit(DATE_CANDIDATE), F.lit(0))


def date_on_page(value: Column, page_text: Column) -> Column:
    """Whether a page shows the day of a written time: as one date, or as day and month in one place and month and year in another."""
    whole = F.exists(date_candidates(page_text), lambda d: F.coalesce(F.left(spoken_time(d)["value"], F.lit(10)) == F.left(value, F.lit(10)), F.lit(False)))
    month = F.get(F.split(F.lit(" ".join(MONTHS)), " "), F.substring(value, 6, 2).try_cast("int") - 1)
    day = F.substring(value, 9, 2).try_cast("int").cast("string")
    of_month = F.concat(F.lit("(?i)\\b(?:"), month, F.lit("[a-z]*\\.?\\s+"), day, F.lit("(?:st|nd|rd|th)?\\b|"), day, F.lit("(?:st|nd|rd|th)?\\s+"), month, F.lit("[a-z]*)"))
    of_year = F.concat(F.lit("(?i)\\b"), month, F.lit("[a-z]*\\.?\\s+"), F.left(value, F.lit(4)), F.lit("\\b"))
    return whole | F.coalesce(F.regexp(page_text, of_month) & F.regexp(page_text, of_year), F.lit(False))
