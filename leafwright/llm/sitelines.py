"""Lines repeated across one source's documents.

Per (source, line) the number of the source's documents that hold the line is compared with the line's
frequency outside the source by a log-likelihood ratio. The outside frequency leaves out sources in which
the line is itself as frequent as that, since furniture shared by sister sites is no background
text; a line that all sources repeat is compared with the mean frequency of the corpus's lines. False discoveries are controlled over all
lines of all sources, whether they pass the repetition thresholds or not. Significant lines that pass the thresholds are excess lines.

A line that stands on a tenth of a source's documents is one of few: a source has at most ten times as many of them as its
documents have lines on average. So each source's excess lines are one short set, which is joined to the documents by source;
the anti-join against it and the putting together by position happen inside the row, and no text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm.lines import same_lines
from leafwright.session import cut, lookup

#: A line is repeated excessively if it stands on at least so many documents and such a share of its source's documents.
MIN_DOCUMENTS, MIN_SHARE = 4, 0.10
#: Expected share of lines wrongly called significant.
FALSE_DISCOVERIES = 0.05
#: Sets of excess lines of up to so many sources are broadcast, more are joined by source and salt.
BROADCAST_SOURCES = 20_000
#: Occurrences outside that a line without any is given.
UNSEEN = 0.5
#: Bins of the test statistic for the step-up procedure; width of a bin.
BINS, BIN_WIDTH = 4000, 0.25


def line_hashes(df: DataFrame, key: str, source: str, text: str, latest: str | None = None) -> DataFrame:
    """(``key``, ``source``, ``hashes``): one row per distinct non-null key, with one hash per line of its text.

    Lines that don't count (blank, only an image placeholder) have a null hash, a null text a null array. Of rows with
    the same key the one with the greatest ``latest`` stands, else any; rows with null source are left out. Texts are
    reduced to hashes before the shuffle, so that whole texts are never moved.
    """
    hashes = F.transform(same_lines(F.col(text)), lambda s: F.when(s.isNotNull(), F.xxhash64(s)))
    rows = df.where(F.col(source).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(source).alias("_source"), (F.col(latest) if latest else F.lit(0)).alias("_at"), hashes.alias("_hashes"))
    one = rows.groupBy("_key").agg(F.max(F.struct("_at", "_source", "_hashes")).alias("_row"))
    return one.select(F.col("_key").alias(key), F.col("_row._source").alias(source), F.col("_row._hashes").alias("hashes"))


def _entropy(*counts: Column) -> Column:
    return sum((F.when(c > 0, c * F.log(c)).otherwise(0.0) for c in counts), F.lit(0.0))


def excess_lines(pages: DataFrame, source: str, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, q: float = FALSE_DISCOVERIES) -> DataFrame:
    """(``source``, ``hash``, ``documents``, ``share``, ``llr``) of the lines repeated excessively within their source.

    ``pages`` is what :func:`line_hashes` gives. Counting is pre-aggregated on the map side, so a line on every page of
    a hot source moves as one row per task. An empty table gives no rows.
    """
    size = pages.groupBy(source).agg(F.count("*").alias("n"))  # a row a source
    line = F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull())))
    counts = cut(pages.select(source, line.alias("hash")).groupBy(source, "hash").agg(F.count("*").alias("k")))
    each = lookup(counts, size, [source], BROADCAST_SOURCES, ["hash"])
    sister = F.col("k") >= min_share * F.col("n")
    held = sister & (F.col("k") >= min_documents)
    total = size.agg(F.sum("n").alias("n_all"))
    mean = each.agg(F.count("*").alias("m"), F.avg(F.col("k") / F.col("n")).alias("mean"))
    # what is outside a line's sources only matters for lines that stand on two documents of a source; moved by line, counts are at most a row a source
    outside = each.groupBy("hash").agg(F.sum(F.when(~sister, F.col("k"))).alias("k_else"), F.sum(F.when(sister, F.col("n"))).alias("n_held"), F.max("k").alias("_most"), F.collect_list(F.when(F.col("k") >= 2, F.struct(F.col(source), "k", "n"))).alias("_in")).where("_most >= 2")
    tested = outside.select("hash", "k_else", "n_held", F.explode("_in").alias("_r")).select("hash", "k_else", "n_held", "_r.*").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(mean))  # a row each
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    own = F.when(sister, F.lit(0)).otherwise(F.col("k"))  # a line below the threshold is part of its own sum
    n_out = F.greatest(F.col("n_all") - F.coalesce(F.col("n_held"), F.lit(0)) - F.when(sister, F.lit(0)).otherwise(F.col("n")), F.lit(0)).cast("double")
    k_out = F.least(F.greatest(F.coalesce(F.col("k_else"), F.lit(0)) - own, F.lit(UNSEEN)).cast("double"), n_out)
    against = 2 * (_entropy(k, n - k, k_out, n_out - k_out) + _entropy(n + n_out) - _entropy(n, n_out) - _entropy(k + k_out, n + n_out - k - k_out))
    rate = F.col("mean")
    alone = 2 * (F.when(k > 0, k * F.log(k / n / rate)).otherwise(0.0) + F.when(n > k, (n - k) * F.log((1 - k / n) / (1 - rate))).otherwise(0.0))
    llr = F.when(n_out > 0, F.when(k / n > k_out / n_out, against)).otherwise(F.when((k / n > rate) & (rate < 1), alone))
    tested = cut(tested.select(source, "hash", "k", "n", "m", F.coalesce(llr, F.lit(0.0)).alias("llr"), F.least(F.floor(F.coalesce(llr, F.lit(0.0)) / BIN_WIDTH), F.lit(BINS)).cast("int").alias("_bin")))
    # Benjamini-Hochberg over all lines of all sources. p is bounded from above by exp(-llr / 2); ranks come from a histogram of bounded size.
    bins = tested.groupBy("_bin").agg(F.count("*").alias("c"), F.max("m").alias("m")).agg(F.collect_list(F.struct("_bin", "c")).alias("h"), F.max("m").alias("m"))  # BINS + 1 entries at most
    at_least = lambda b: F.aggregate("h", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["_bin"] >= b, x["c"]).otherwise(0))
    passing = F.filter("h", lambda x: F.exp(-x["_bin"] * BIN_WIDTH / 2) * F.col("m") <= q * at_least(x["_bin"]))
    cutoff = bins.select(F.array_min(F.transform(passing, lambda x: x["_bin"])).alias("_least"))
    found = tested.where(held).join(F.broadcast(cutoff), F.col("_bin") >= F.col("_least"))  # one row
    return found.select(source, "hash", F.col("k").alias("documents"), (F.col("k") / F.col("n")).alias("share"), "llr")


def _with_excess(pages: DataFrame, excess: DataFrame, source: str, spread: str) -> DataFrame:
    """``pages`` with ``_gone``, the set of their source's excess lines; null where there is none."""
    sets = excess.groupBy(source).agg(F.collect_set("hash").alias("_gone"))
    return lookup(pages, sets, [source], BROADCAST_SOURCES, [spread], "left")


def excess_occurrences(pages: DataFrame, key: str, source: str, **limits: float) -> DataFrame:
    """(``key``, ``line_no``): every occurrence of an excess line; lines are counted from 1."""
    rows = _with_excess(pages, excess_lines(pages, source, **limits), source, key).where(F.col("_gone").isNotNull())
    places = F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains("_gone", h), i + 1)), lambda x: x.isNotNull())
    return rows.select(key, F.explode(places).alias("line_no"))


def remove_excess_lines(df: DataFrame, key: str, source: str, text: str, latest: str | None = None, **limits: float) -> DataFrame:
    """(``key``, ``source``, ``text``, ``removed``): texts without the excess lines of their source, one row per row of ``df``.

    What repeats is counted over distinct keys, as in :func:`line_hashes`. Texts of a null source and null texts come back as
    they are. A text of which all lines are removed becomes empty. Other columns are ignored.
    """
    pages = cut(line_hashes(df, key, source, text, latest))
    rows = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    sets = excess_lines(pages, source, **limits).select(F.col(source).alias("_source"), "hash")
    rows = _with_excess(rows, sets, "_source", "_text")
    hashes = F.transform(same_lines(F.when(F.col("_gone").isNotNull(), F.col("_text"))), lambda s: F.when(s.isNotNull(), F.xxhash64(s)))
    rows = rows.withColumn("_hashes", hashes)
    kept = F.filter(F.split("_text", "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("_gone", F.get("_hashes", i)), F.lit(False)))
    rows = rows.withColumn("_kept", F.when(F.col("_hashes").isNotNull(), kept))
    removed = F.coalesce(F.size("_hashes") - F.size("_kept"), F.lit(0))
    return rows.select(F.col("_key").alias(key), F.col("_source").alias(source), F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col("_text")).alias(text), removed.alias("removed"))
