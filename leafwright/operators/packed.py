"""Several values packed in one field, split into one value per row with its position.

Each string is cut into tokens (a quoted string, a bracketed remark, a word, a blank, any other
character), and each token is masked to one code letter, so that a string has a short delimiter
skeleton. Splitting rules are worked out once per distinct skeleton, joined back, and applied as
token slices. Tokens, skeletons and slices are JVM expressions; Python sees distinct skeletons only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.session import lookup

#: Rules up to this many distinct skeletons are broadcast (some 100 bytes each), more are joined by skeleton and salt, since common skeletons are hot.
RULES_BROADCAST_ROWS = 50_000

# Words with a part in splitting, by what they do.
JOINING = "and|und|y|e|et|и|en|og|och|和|与|及"
INTRODUCING = "By|by|BY|Von|von|Par|par|Por|por|De|Text|Автор|Авторы|Autor|Autores|Auteur|Author|Authors|作者|记者|文|撰文|图|摄影|编辑|通讯员"
SUFFIXES = "PhD|Ph\\.D\\.?|Jr\\.?|Sr\\.?|MD|M\\.D\\.?|MBA|MSc|MA|BA|BSc|DPhil|LLD|JD|RN|CPA|Esq\\.?|II|III|IV|OBE|CBE|MP"
BODIES = "Association|Office|Company|Bureau|College|Trust|Board|Fund|Agency|Press|Institute|University|Council|Society|Service|Services|Group|Ltd|Inc|Inc\\.|LLC|GmbH|AG|Committee|Department|Ministry|Union|Federation|News|Newsroom|Media|Team|Desk|Foundation|Authority|Commission|Corporation|Partners|Laboratory|Centre|Center|Museum|School|Mines|Party|Bank|Club|Редакция|Агентство|Бюро|Ассоциация|Компания"
HAN_BODIES = "局|馆|公司|社|站|协会|院|部|中心|委员会|报|台|所|大学|网|集团|组|室|会"

TOKEN = "\"[^\"\\\\]*+(?:(?:\\\\[\\s\\S]|\"\")[^\"\\\\]*+)*+\"|\\([^()]*\\)|（[^（）]*）|[\\p{IsHan}]+|[\\p{L}\\p{M}\\p{N}'’.\\-&&[^\\p{IsHan}]]+|[ \\u00a0]+|[\\s\\S]"
SLICES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _code(token: Column) -> Column:
    return (
        F.when(token.rlike("^[ \\u00a0]+$"), "_")
        .when(token == "\n", "n")
        .when(token == "\r", "n")
        .when(token == "\t", "t")
        .when(token == "　", "z")
        .when(token.rlike('^".*"$') & (F.length(token) > 1), "q")
        .when(token.rlike("^[(（][\\s\\S]*[)）]$"), "p")
        .when(token.rlike(f"^(?:{JOINING})$"), "c")
        .when(token.rlike(f"^(?:{INTRODUCING})$"), "b")
        .when(token.rlike(f"^(?:{SUFFIXES})$"), "s")
        .when(token.rlike(f"^(?:{BODIES})$"), "o")
        .when(token.rlike("^\\p{IsHan}"), F.when(token.rlike(f"(?:{HAN_BODIES})$") & (F.length(token) > 2), "k").when(F.length(token) <= 4, "h").otherwise("k"))
        .when(token.rlike("^\\p{Ll}"), "l")
        .when(token.rlike("^[\\p{L}\\p{M}\\p{N}'’.\\-]"), "w")
        .when(token.rlike("^[a-z]$"), "w")
        .otherwise(token)
    )


def skeleton(token_array: Column) -> Column:
    """One code letter per token."""
    return F.array_join(F.transform(token_array, _code), "")


BLANK, STRONG, COMMA = set("_ntz"), set(";；|｜/／nt、"), set(",，")
DOTS = set("·・•∙")


def _strip(skel: str, a: int, b: int) -> tuple[int, int]:
    while a < b and skel[a] in BLANK:
        a += 1
    while b > a and skel[b - 1] in BLANK:
        b -= 1
    return a, b


def _words(skel: str, a: int, b: int) -> int:
    return sum(c in "wlohkscbq" for c in skel[a:b])


def _pieces(skel: str, a: int, b: int) -> list[list]:
    """[start, end, separator before] of what lies between commas, joining words and, among Han names, blanks."""
    found, start, before = [], a, ""
    han = all(c in "hkp_z,，c&＆" for c in skel[a:b]) and "h" in skel[a:b]
    for i in range(a, b + 1):
        c = skel[i] if i < b else "end"
        if c in COMMA or c in ("c", "&", "＆", "end") or c == "z" or (han and c == "_" and i + 1 < b and skel[i + 1] in "hk"):
            x, y = _strip(skel, start, i)
            if x < y:
                found.append([x, y, before])
                before = ""
            if c != "end":
                before = "," if c in COMMA and before != "c" else "c"
            start = i + 1
    return found


def resolve(skel: str) -> list[tuple[int, int]]:
    """Token slices (first token counted from 1, number of tokens), one per value that the skeleton packs."""
    a, b = 0, len(skel)
    while a < b and (skel[a] in BLANK or skel[a] == "["):
        a += 1
    while b > a and (skel[b - 1] in BLANK or skel[b - 1] == "]"):
        b -= 1
    while a < b and skel[a] == "b":  # introducing words, with a colon, bar or blank behind them
        i = a + 1
        while i < b and skel[i] in "_z:：｜|n/":
            i += 1
        if i == a + 1 or i >= b:
            break
        a = i
    segments, start = [], a
    for i in range(a, b):
        c = skel[i]
        dot = c in DOTS and not (0 < i < len(skel) - 1 and skel[i - 1] in "hkw" and skel[i + 1] in "hkw" and (skel[i - 1] in "hk") == (skel[i + 1] in "hk"))
        if c in STRONG or dot:
            segments.append((start, i))
            start = i + 1
    segments.append((start, b))
    items: list[tuple[int, int]] = []
    for x, y in segments:
        parts: list[list] = []
        for p in _pieces(skel, x, y):
            bare = skel[p[0] : p[1]].replace("_", "")
            if parts and p[2] and bare and all(c in "sp" for c in bare):  # a degree or a role belongs to the name before it
                parts[-1][1] = p[1]
            else:
                parts.append(p)
        for k in range(len(parts) - 1, 0, -1):  # a body named after several places or people
            body = skel[parts[k][0] : parts[k][1]]
            if "o" in body and not parts[k][3:]:
                j = k
                while j > 0 and skel[parts[j - 1][0] : parts[j - 1][1]] == "w" and parts[j][2]:
                    j -= 1
                if j < k:
                    parts[j : k + 1] = [[parts[j][0], parts[k][1], parts[j][2], True]]
                    break
        k = 0
        while k < len(parts):
            p = parts[k]
            single = [c for c in skel[p[0] : p[1]] if c in "wlohkcbq"]
            if k + 1 < len(parts) and parts[k + 1][2] == "," and single == ["w"]:
                q = parts[k + 1]
                if [c for c in skel[q[0] : q[1]] if c in "wlohkcbq"] == ["w"]:  # family name first
                    p = [p[0], q[1]]
                    k += 1
            items.append((p[0] + 1, p[1] - p[0]))
            k += 1
    return items


@F.pandas_udf(SLICES)
def _resolve(skeletons: pd.Series) -> pd.Series:
    return skeletons.map(lambda s: [] if s is None else resolve(s))


def _clean(item: Column) -> Column:
    blank = "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$"
    item = F.regexp_replace(item, blank, "")
    escaped = F.try_element_at(F.from_json(F.concat(F.lit("["), item, F.lit("]")), "array<string>"), F.lit(1))  # "\\u8c0c" and the like
    inner = F.regexp_replace(F.regexp_extract(item, '^"([\\s\\S]*)"$', 1), '""', '"')
    inner = F.when(item.contains("\\"), F.coalesce(escaped, inner)).otherwise(inner)
    return F.when(item.rlike('^"[\\s\\S]*"$') & (F.length(item) > 1), F.regexp_replace(inner, blank, "")).otherwise(item)


def split_packed(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """One row (``keys``, ``item_no``, ``item``, ``packed``) per value held by the strings of array column ``values``.

    ``item_no`` counts from 1 over all strings of the array in order; ``packed`` tells whether any string
    of the array holds two or more values. Null arrays, null strings and strings without a value give no
    rows. Rows that agree in keys and array count once. Other columns of ``df``, whatever their names, are
    ignored. A string of any length is split whole. Keys may be null.
    """
    row = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(values).alias("_v")).where(F.size("_v") > 0).distinct()
    names = [f"_k{i}" for i in range(len(keys))] + ["_v"]
    each = row.select(*names, F.posexplode("_v").alias("_at", "_s")).where(F.col("_s").isNotNull())
    each = each.withColumn("_t", tokens(F.col("_s"))).withColumn("_skel", skeleton(F.col("_t"))).drop("_s")
    rules = each.select("_skel").distinct().withColumn("_rule", _resolve("_skel"))
    each = lookup(each, rules, ["_skel"], RULES_BROADCAST_ROWS, [*names, "_at"])
    part = F.transform("_rule", lambda r: _clean(F.array_join(F.slice("_t", r["start"], r["length"]), "")))
    each = each.withColumn("_items", F.filter(part, lambda x: x != ""))
    together = each.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_at", "_items"))).alias("_all"))
    flat = together.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        F.exists("_all", lambda e: F.size(e["_items"]) > 1).alias("packed"),
        F.posexplode(F.flatten(F.transform("_all", lambda e: e["_items"]))).alias("_no", "item"),
    )
    return flat.select(*keys, (F.col("_no") + 1).cast("int").alias("item_no"), "item", "packed").distinct()


def may_be_packed(text: Column) -> Column:
    """False only where a string surely holds one value: it has no delimiter and no blank next to a Han character."""
    return text.rlike("[,;|/·・•∙&、，；｜／＆\\n\\t\"\\[\\u3000]| (?:and|und|y|e|et|и|en|og|och) |\\p{IsHan}[ \\u00a0]+\\p{IsHan}|和|与|及")
