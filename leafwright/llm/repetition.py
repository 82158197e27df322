"""Repetition inside a single document.

A table of named ratios and thresholds is compiled into one projection of built-in expressions; no user
function runs and nothing is shuffled. A passage is a whole sentence or line (hence a paragraph, too), or a run of
eight words, sixteen characters where the text is mainly Han. Letter case, spacing, digits and punctuation
don't distinguish passages.

Whether a text repeats anything is seen from the distinct hashes of its runs and pieces. Only where it does,
passages are found by sorting (hash, position) pairs: whatever has the hash of its neighbour before it occurred
earlier in the text. One fold over the words then adds up the characters that lie in such passages, so the work is
n log n in the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_WORDS, RUN_CHARACTERS = 8, 16

# Frequent function words of the languages at hand.
STOP_WORDS = "the of and to in a is was for on that with as by at from it be der die das und ist von zu den mit le la les de et des du un une est que el los las en y por una o a da do em um uma não и в не на что с по это".split()

#: Where a sentence or line ends; a full stop inside a number or word ends none.
ENDS = "\\n+|[.!?…]+[\"”“’»)\\]]*\\s+|[。！？]+[\"”“’»)\\]]*"
@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if ``measure`` compares to ``limit`` by ``sense`` (``>=`` or ``<``)."""

    name: str
    measure: str
    sense: str
    limit: float

    def broken(self) -> Column:
        value = F.col(self.measure)
        return F.coalesce(value >= self.limit if self.sense == ">=" else value < self.limit, F.lit(False))


#: The threshold table. Only ``passages`` decides what counts as repetitive, the others describe a document.
RULES = (
    Rule("passages", "repeated_share", ">=", 0.30),
    Rule("pieces", "piece_share", ">=", 0.30),
    Rule("one_word", "top_word_share", ">=", 0.20),
    Rule("symbols", "symbol_share", ">=", 0.10),
    Rule("no_stop_words", "stop_share", "<", 0.01),
    Rule("short", "n_characters", "<", 50),
)


def _order(hashes: str) -> Column:
    """The (hash, position) pairs of an array of hashes, sorted."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _earlier(order: str) -> Column:
    """Per position, in order, whether its hash occurs at an earlier one."""
    before = F.concat(F.array(F.lit(None)), F.col(order))
    marked = F.zip_with(order, before, lambda x, y: F.when(x.isNotNull(), F.struct(x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("old"))))
    return F.transform(F.sort_array(F.array_compact(marked)), lambda x: x["old"])


def measure(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the measures of ``text``.

    ``n_characters``, ``repeated_share`` (share of characters in passages that occurred earlier in the same text),
    ``piece_share`` (the same for whole sentences and lines alone), ``top_word_share``, ``symbol_share``
    and ``stop_share``. Null and empty texts and texts without a word have 0 everywhere. Texts are read whole. Columns of
    ``df`` of these names are replaced, others stay.
    """
    names = ["n_characters", "repeated_share", "piece_share", "top_word_share", "symbol_share", "stop_share"]
    df = df.drop(*names)
    work = df.withColumn("_t", F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "\\p{N}+", "0"))
    marked = F.regexp_replace(F.regexp_replace("_t", ENDS, "\n"), "[^\\p{L}\\p{M}\\p{N}\\n]+", " ")
    work = work.withColumn("_plain", marked).withColumn("_with_han", (F.octet_length("_plain") > F.length("_plain")) & F.col("_plain").rlike("\\p{IsHan}"))
    work = work.withColumn("_marked", F.when(F.col("_with_han"), F.regexp_replace("_plain", "(\\p{IsHan})", " $1 ")).otherwise(F.col("_plain")))
    work = work.withColumn("_words", F.array_remove(F.split(F.replace("_marked", F.lit("\n"), F.lit(" ")), " "), ""))
    work = work.withColumn("_n", F.size("_words"))
    han = F.when(F.col("_with_han"), F.length(F.regexp_replace("_plain", "\\P{IsHan}+", ""))).otherwise(0)
    work = work.withColumn("_run", F.when(han * 2 > F.col("_n"), RUN_CHARACTERS).otherwise(RUN_WORDS))
    # hashes of runs of one word are joined to those of runs of two, of four and so on
    work = work.withColumn("_hash1", F.transform("_words", lambda w: F.xxhash64(w)))
    width = 1
    while width < RUN_CHARACTERS:
        wider = lambda h, w: F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - w, F.lit(0))), F.slice(h, F.lit(w + 1), F.greatest(F.size(h) - w, F.lit(0))), lambda x, y: F.xxhash64(x, y))
        longer = wider(f"_hash{width}", width)
        work = work.withColumn(f"_hash{2 * width}", longer if 2 * width <= RUN_WORDS else F.when(F.col("_run") == RUN_CHARACTERS, longer))
        width *= 2
    work = work.withColumn("_run_hash", F.when(F.col("_run") == RUN_WORDS, F.col(f"_hash{RUN_WORDS}")).otherwise(F.col(f"_hash{RUN_CHARACTERS}")))
    work = work.withColumn("_pieces", F.filter(F.split("_marked", "\n"), lambda p: F.trim(p) != ""))
    work = work.withColumn("_piece_hash", F.transform("_pieces", lambda p: F.xxhash64(F.replace(p, F.lit(" "), F.lit("")))))
    repeats = (F.size(F.array_distinct("_run_hash")) < F.size("_run_hash")) | (F.size(F.array_distinct("_piece_hash")) < F.size("_piece_hash"))
    work = work.withColumn("_repeats", repeats)
    only = lambda c: F.when(F.col("_repeats"), c)
    work = work.withColumn("_run_order", only(_order("_run_hash"))).withColumn("_runs", _earlier("_run_order")).drop("_run_order", "_run_hash")
    work = work.withColumn("_piece_order", only(_order("_piece_hash"))).withColumn("_old_pieces", _earlier("_piece_order")).drop("_piece_order")
    # per word whether its whole sentence or line occurred earlier
    old = F.flatten(F.zip_with("_pieces", "_old_pieces", lambda p, o: F.array_repeat(o, F.size(F.array_remove(F.split(p, " "), "")))))
    work = work.withColumn("_old", only(old))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("until"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("whole"), F.lit(0).cast("long").alias("all"))

    # what the fold reads comes as its elements: a column that a lambda names would be worked out anew for each element
    def step(acc: Column, x: Column) -> Column:
        length = F.length(x["_words"]) + F.when(F.col("_run") == RUN_WORDS, 1).otherwise(0)  # with the blank behind it
        until = F.when(F.coalesce(x["_runs"], F.lit(False)), acc["i"] + F.col("_run")).otherwise(acc["until"])
        piece = F.coalesce(x["_old"], F.lit(False))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            until.alias("until"),
            (acc["total"] + F.when(piece | (acc["i"] < until), length).otherwise(0)).alias("total"),
            (acc["whole"] + F.when(piece, length).otherwise(0)).alias("whole"),
            (acc["all"] + length).alias("all"),
        )

    work = work.withColumn("_sum", only(F.aggregate(F.arrays_zip("_words", "_runs", "_old"), start, step)))
    order = F.sort_array(F.transform("_words", lambda w: F.xxhash64(w)))
    work = work.withColumn("_sorted", order)
    run = F.aggregate(
        "_sorted",
        F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("n"), F.lit(0).alias("most")),
        lambda acc, h: F.struct(h.alias("h"), F.when(acc["h"] == h, acc["n"] + 1).otherwise(1).alias("n"), F.greatest(acc["most"], F.when(acc["h"] == h, acc["n"] + 1).otherwise(1)).alias("most")),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    symbols = F.length(F.regexp_replace("_t", "[\\p{L}\\p{M}\\p{N}\\s.,;:!?'\"’‘“”„«»()\\-–—。，、；：！？（）]+", ""))
    stops = F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS)))
    return work.select(
        *df.columns,
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_characters"),
        share(F.col("_sum.total"), F.col("_sum.all")).alias("repeated_share"),
        share(F.col("_sum.whole"), F.col("_sum.all")).alias("piece_share"),
        share(run["most"], F.col("_n")).alias("top_word_share"),
        share(symbols, F.length("_t")).alias("symbol_share"),
        share(stops, F.col("_n")).alias("stop_share"),
    )


def judge(df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """:func:`measure` with ``broken``, the names of the rules that a document breaks."""
    measured = measure(df.drop("broken"), text)
    return measured.withColumn("broken", F.filter(F.array(*[F.when(r.broken(), r.name) for r in rules]), lambda n: n.isNotNull()))
